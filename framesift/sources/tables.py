"""Readers and writers: nested frame JSON, probe JSON, file manifests, selection manifests."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The keys of a frame document. A box is [x1, y1, x2, y2], a landmark [x, y], a keypoint [x, y, confidence], a classification [label, confidence].
FRAME_JSON = """
    video_id long, frame_id string, file_path string,
    source_info struct<video_timestamp:double,extraction_method:string,original_frame_number:long,video_fps:double>,
    image_properties struct<width:int,height:int,channels:int,file_size_bytes:long,format:string,color_space:string>,
    face_detections array<struct<bbox:array<int>,confidence:double,landmarks:array<array<double>>,area:long>>,
    pose_detections array<struct<bbox:array<int>,confidence:double,keypoints:map<string,array<double>>,pose_classifications:array<array<string>>>>,
    head_poses array<struct<yaw:double,pitch:double,roll:double,confidence:double,direction:string,face_id:int>>,
    quality_metrics struct<laplacian_variance:double,sobel_variance:double,brightness_score:double,contrast_score:double,overall_quality:double,quality_issues:array<string>,usable:boolean>,
    closeup_detections array<struct<is_closeup:boolean,shot_type:string,confidence:double,face_area_ratio:double,inter_ocular_distance:double,estimated_distance:string,shoulder_width_ratio:double>>,
    persons array<struct<person_id:int,
        face:struct<type:string,bbox:array<int>,confidence:double,landmarks:array<array<double>>>,
        body:struct<type:string,bbox:array<int>,confidence:double,keypoints:map<string,array<double>>,pose_classifications:array<array<string>>>,
        head_pose:struct<yaw:double,pitch:double,roll:double,confidence:double,face_id:int,direction:string,direction_confidence:double>,
        quality:struct<face_quality:double,body_quality:double,overall_quality:double>>>,
    selections struct<selected_for_poses:array<string>,selected_for_head_angles:array<string>,final_output:boolean,output_files:array<string>,crop_regions:map<string,array<int>>,selection_rank:int,quality_rank:int,
        category_scores:map<string,double>,category_score_breakdowns:map<string,map<string,double>>,category_ranks:map<string,int>,primary_selection_category:string,selection_competition:map<string,string>,
        final_selection_score:double,rejection_reason:string>,
    processing_timings struct<face_detection_ms:double,pose_estimation_ms:double,head_pose_estimation_ms:double,quality_assessment_ms:double,closeup_detection_ms:double,total_processing_ms:double>,
    debug_info map<string,string>, _corrupt_record string"""

#: What a missing field of a document stands for; fields that are not named are null, arrays and maps empty.
DEFAULTS = {
    "source_info": {"video_timestamp": 0.0, "extraction_method": "unknown", "original_frame_number": 0, "video_fps": 30.0},
    "image_properties": {"width": 0, "height": 0, "channels": 3, "file_size_bytes": 0, "format": "JPG", "color_space": "RGB"},
    "face_detections": {"bbox": [0, 0, 0, 0], "confidence": 0.0},
    "pose_detections": {"bbox": [0, 0, 0, 0], "confidence": 0.0},
    "head_poses": {"yaw": 0.0, "pitch": 0.0, "roll": 0.0, "confidence": 0.0, "direction": "unknown", "face_id": 0},
    "quality_metrics": {"laplacian_variance": 0.0, "sobel_variance": 0.0, "brightness_score": 0.0, "contrast_score": 0.0, "overall_quality": 0.0, "usable": True},
    "closeup_detections": {"is_closeup": False, "shot_type": "unknown", "confidence": 0.0, "face_area_ratio": 0.0},
    "selections": {"final_output": False},
}

PROBE_JSON = """
    streams array<struct<codec_type:string,codec_name:string,width:int,height:int,duration:string,r_frame_rate:string,avg_frame_rate:string>>,
    format struct<duration:string,format_name:string,size:string>"""


def parse_frames(lines: DataFrame, column: str = "value") -> DataFrame:
    """Frames from JSON text, a frame a row. Broken text and frames without `selections` are left out; missing fields get defaults."""
    f = F.from_json(column, FRAME_JSON, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # `inline` makes its columns once; conditions on a plain struct of them would parse the text again, each of them
    rows = lines.select(F.inline(F.array(f))).where("_corrupt_record is null and selections is not null").drop("_corrupt_record")
    return with_defaults(rows)


def read_frames(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Frames from files of JSON documents, one a line (or one a file, or an array of them, if `whole`), as parse_frames."""
    rows = spark.read.schema(FRAME_JSON).option("mode", "PERMISSIVE").option("multiLine", whole).json(path)
    return with_defaults(rows.where("_corrupt_record is null and selections is not null").drop("_corrupt_record"))


def _filled(value: Column, kind: T.StructType, defaults: dict) -> Column:
    """A struct with defaults for its missing fields; arrays and maps are empty by default."""
    out = []
    for f in kind.fields:
        x = value[f.name]
        if f.name in defaults:
            d = defaults[f.name]
            x = F.coalesce(x, (F.array(*map(F.lit, d)) if isinstance(d, list) else F.lit(d)).cast(f.dataType))
        elif isinstance(f.dataType, T.MapType):
            x = F.coalesce(x, F.create_map().cast(f.dataType))
        elif isinstance(f.dataType, T.ArrayType) and f.name != "landmarks":
            x = F.coalesce(x, F.array().cast(f.dataType))
        out.append(x.alias(f.name))
    return F.struct(*out)


def _element(kind: T.StructType, defaults: dict):
    return lambda e: _filled(e, kind, defaults)


def with_defaults(rows: DataFrame) -> DataFrame:
    new = {}
    for name, defaults in DEFAULTS.items():
        kind = rows.schema[name].dataType
        if isinstance(kind, T.ArrayType):
            new[name] = F.coalesce(F.transform(name, _element(kind.elementType, defaults)), F.array().cast(kind))
        elif name == "quality_metrics":
            new[name] = F.when(F.col(name).isNotNull(), _filled(F.col(name), kind, defaults))
        else:
            new[name] = _filled(F.col(name), kind, defaults)
    new["persons"] = F.coalesce("persons", F.array().cast(rows.schema["persons"].dataType))
    return rows.withColumns(new)


def child(frames: DataFrame, column: str, fill: bool = False) -> DataFrame:
    """One row an element: video_id, frame_id, its place `idx`, its fields; a box becomes x1, y1, x2, y2. fill: missing fields get defaults, as with_defaults gives them to whole lists, at less cost."""
    out = frames.select("video_id", "frame_id", F.posexplode(column).alias("idx", "e"))
    e = _filled(F.col("e"), frames.schema[column].dataType.elementType, DEFAULTS[column]) if fill else F.col("e")
    out = out.select("video_id", "frame_id", "idx", e.alias("e")).select("video_id", "frame_id", "idx", "e.*")
    return out.select("*", *[F.col("bbox")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]).drop("bbox") if "bbox" in out.columns else out


def boxes(frames: DataFrame, **kinds: str) -> DataFrame:
    """The rows of several arrays of detections by one pass: video_id, frame_id, kind, its place `idx`, x1, y1, x2, y2, conf. kinds: the column of each kind."""
    at = ("x1", "y1", "x2", "y2")
    one = lambda kind: lambda e, i: F.struct(F.lit(kind).alias("kind"), i.alias("idx"), *[F.get(e["bbox"], F.lit(k)).alias(c) for k, c in enumerate(at)], e["confidence"].alias("conf"))
    return frames.select("video_id", "frame_id", F.inline(F.concat(*[F.transform(column, one(kind)) for kind, column in kinds.items()])))


def persons(frames: DataFrame) -> DataFrame:
    """One row a person of a frame: video_id, frame_id, person_id, its face, body, head pose and quality. An unknown face or body is null."""
    out = frames.select("video_id", "frame_id", F.explode("persons").alias("p")).select("video_id", "frame_id", "p.*")
    known = lambda c, unknown: F.when(F.coalesce(F.col(c)["type"], F.lit("")) != unknown, F.col(c))
    return out.withColumns({"face": known("face", "FaceUnknown"), "body": known("body", "BodyUnknown")})


def _fields(name: str) -> list[T.StructField]:
    """Fields of an element of the array `name` of a document."""
    return T.StructType.fromDDL(FRAME_JSON)[name].dataType.elementType.fields


def _one(df: DataFrame, name: str, known: dict[str, Column]) -> Column:
    """A row of df as an element of the array `name` of a document. Fields come from `known`, from columns of their name, or are null."""
    return F.struct(*[known.get(f.name, F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _fields(name)])


def _listed(df: DataFrame, name: str, order: Column, known: dict[str, Column]) -> Column:
    """The rows of df with an `order`, in it, as the array `name` of a document."""
    rows = F.collect_list(F.when(order.isNotNull(), F.struct(order.alias("o"), _one(df, name, known).alias("e"))))
    placed = F.array_sort(rows, lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
    return placed["e"].alias(name)


def _both_lists(detections: DataFrame, key: list[str], known: dict[str, Column], piece: int = 256) -> DataFrame:
    """The faces and bodies of each frame as arrays in the order of `idx`, after one sort. Pieces of some rows are listed first and then put together, as a window of all rows makes its list for each of them."""
    kinds = {"face_detections": "face", "pose_detections": "body"}
    rows = Window.partitionBy(*key).orderBy("idx")
    lists = [F.collect_list(F.when((F.col("kind") == kind) & F.col("idx").isNotNull(), _one(detections, name, known))).over(rows.rowsBetween(0, piece - 1)).alias(name) for name, kind in kinds.items()]
    pieces = detections.select(*key, "idx", *lists, F.row_number().over(rows).alias("_n")).where(F.col("_n") % piece == 1)
    whole = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = pieces.select(*key, "_n", *kinds, *[F.collect_list(F.when(F.col("_n") > 1, F.struct("_n", F.col(name).alias("e")))).over(whole).alias(f"_{name}") for name in kinds]).where("_n = 1")
    in_order = lambda c: F.flatten(F.array_sort(c, lambda a, b: F.when(a["_n"] < b["_n"], -1).otherwise(1))["e"])
    return first.select(*key, *[F.when(F.size(f"_{name}") == 0, F.col(name)).otherwise(F.concat(name, in_order(F.col(f"_{name}")))).alias(name) for name in kinds])


def nest(frames: DataFrame | None, detections: DataFrame, head_poses: DataFrame | None = None, closeups: DataFrame | None = None, people: DataFrame | None = None) -> DataFrame:
    """Frames with the rows of their child tables as arrays in list order, in the document's form.

    frames: None stands for the frames that have detections, which takes no join. All have video_id and frame_id. detections: kind, idx, x1, y1, x2, y2, conf, and landmarks, keypoints, pose_classifications where
    known. head_poses and closeups: idx, and fields of theirs. people: person_id, face_idx, body_idx (places among the
    frame's detections, null if unknown), face_quality, body_quality, overall.
    """
    key = ["video_id", "frame_id"]
    box = {"bbox": F.array("x1", "y1", "x2", "y2"), "confidence": F.col("conf"), "area": (F.col("x2") - F.col("x1")).cast("long") * (F.col("y2") - F.col("y1"))}
    out = _both_lists(detections, key, box)
    if frames is not None:
        out = frames.join(out, key, "left")
    for name, rows in (("head_poses", head_poses), ("closeup_detections", closeups)):
        if rows is not None:
            out = out.join(rows.groupBy(*key).agg(_listed(rows, name, F.col("idx"), {})), key, "left")
    if people is None:
        return out
    cols = [F.struct("person_id", "face_idx", "body_idx", "face_quality", "body_quality", "overall").alias("p")]
    found = out.join(people.select(*key, *cols).groupBy(*key).agg(F.array_sort(F.collect_list("p")).alias("_people")), key, "left")
    kind = {f.name: f.dataType for f in _fields("persons")}

    def part(name, column, of, index, unknown):
        of_side = F.get(of, index)
        fields = [F.lit(name).alias("type"), *[of_side[f.name].cast(f.dataType).alias(f.name) for f in kind[column].fields if f.name != "type"]]
        return F.when(index.isNotNull() & of_side.isNotNull(), F.struct(*fields)).otherwise(F.struct(F.lit(unknown).alias("type"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in kind[column].fields if f.name != "type"])).alias(column)

    def person(p):
        pose = F.get(F.filter("head_poses", lambda h: h["face_id"] == p["face_idx"]), F.lit(0)) if head_poses is not None else F.lit(None)
        head = F.struct(*[(pose[f.name] if head_poses is not None and f.name != "direction_confidence" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind["head_pose"].fields])
        quality = F.struct(p["face_quality"].alias("face_quality"), p["body_quality"].alias("body_quality"), p["overall"].alias("overall_quality"))
        return F.struct(
            p["person_id"].cast("int").alias("person_id"), part("FaceDetection", "face", F.col("face_detections"), p["face_idx"].cast("int"), "FaceUnknown"), part("PoseDetection", "body", F.col("pose_detections"), p["body_idx"].cast("int"), "BodyUnknown"),
            (F.when(pose.isNotNull(), head) if head_poses is not None else F.lit(None).cast(kind["head_pose"])).alias("head_pose"), quality.alias("quality"),
        )

    return found.withColumn("persons", F.transform("_people", person)).drop("_people")


def as_json(frames: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (by default the keys) and a line of JSON a frame of all other columns, the default keys included, with nulls. Confidences of classifications are numbers, as the documents have them."""
    fields = [c for c in frames.columns if c not in (carry or [])]
    text = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) if c == "frame_id" else c for c in fields]), {"ignoreNullFields": "false"})
    number = F.regexp_replace("value", r'\["([A-Za-z_]+)","([-+0-9.eE]+)"\]', r'["$1",$2]')
    rows = frames.select(*(carry or ["video_id", "frame_id"]), text.alias("value"))
    return rows.withColumn("value", F.when(F.contains("value", F.lit('["')), number).otherwise(F.col("value")))


def write_frames(frames: DataFrame, path: str) -> None:
    """Files of JSON documents, one a line."""
    as_json(frames).select("value").write.mode("overwrite").text(path)


def _rate(text: Column) -> Column:
    num, den = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")
    return F.when(F.contains(text, F.lit("/")), F.coalesce(F.try_divide(num, F.nullif(den, F.lit(0.0))), F.lit(0.0))).otherwise(text.try_cast("double"))


def parse_probe(rows: DataFrame, column: str = "value") -> DataFrame:
    """Video metadata from a probing tool's JSON text; rows without a video stream, size, duration or rate are left out."""
    p = rows.withColumn("p", F.from_json(column, PROBE_JSON))
    p = p.withColumn("s", F.try_element_at(F.filter("p.streams", lambda s: s["codec_type"] == "video"), F.lit(1)))
    positive = lambda c: F.when(c > 0, c)
    duration = F.coalesce(positive(F.col("p.format.duration").try_cast("double")), positive(F.col("s.duration").try_cast("double")))
    fps = F.coalesce(positive(_rate(F.col("s.r_frame_rate"))), positive(_rate(F.col("s.avg_frame_rate"))))
    out = p.withColumn("duration", duration).withColumn("fps", fps)
    keep = [c for c in rows.columns if c != column]
    return out.where("duration is not null and fps is not null and s.width > 0 and s.height > 0").select(
        *keep, "duration", "fps", F.col("s.width").alias("width"), F.col("s.height").alias("height"), F.coalesce("s.codec_name", F.lit("unknown")).alias("codec"),
        F.split_part(F.coalesce("p.format.format_name", F.lit("unknown")), F.lit(","), F.lit(1)).alias("format"), F.col("p.format.size").try_cast("long").alias("file_size_bytes"), (F.col("duration") * F.col("fps")).cast("int").alias("total_frames"),
    )


def file_manifest(spark: SparkSession, path: str, glob: str = "*", in_row: int = 1 << 28) -> DataFrame:
    """path, size, extension and SHA-256 of files. Files of up to `in_row` bytes are hashed as a row, larger ones are read in pieces by a task each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    named = [F.col("path"), F.col("length").alias("size"), F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension")]

    def hashed(batches):
        for b in batches:
            out = []
            for uri in b.column("path").to_pylist():
                system, place = FileSystem.from_uri(uri)
                digest = hashlib.sha256()
                with system.open_input_stream(place) as data:
                    while piece := data.read(1 << 22):
                        digest.update(piece)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "sha256"])

    small = files.where(F.col("length") <= in_row).select(*named, F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > in_row).select(*named).mapInArrow(hashed, "path string, size long, extension string, sha256 string")
    return small.unionByName(large)


def write_selection(rows: DataFrame, path: str) -> None:
    """The final outputs, a folder a video and kind."""
    rows.write.mode("overwrite").partitionBy("video_id", "kind").parquet(path)
