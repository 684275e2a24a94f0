"""Detection-like views over the driver's tables, for Spark and as DuckDB text. Both give equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_WORDS = {
    "spark": {
        "{US}": "unix_micros(cast(ts as timestamp))",
        **{f"{{E{k}}}": f"cast(embedding[{k - 1}] as double)" for k in (52, 53, 54, 55)},
        **{f"{{EI{j}}}": f"cast(e.embedding[3*b.i+{j}] as double)" for j in range(3)},
        "{RASTER}": "transform(embedding, e -> cast(least(255, greatest(0, floor((cast(e as double)+6e-1)*2e2))) as int))",
    },
    "duckdb": {
        "{US}": "epoch_us(ts)",
        **{f"{{E{k}}}": f"cast(embedding[{k}] as double)" for k in (52, 53, 54, 55)},
        **{f"{{EI{j}}}": f"cast(e.embedding[3*b.i+{j + 1}] as double)" for j in range(3)},
        "{RASTER}": "list_transform(embedding, lambda e: cast(least(255, greatest(0, floor((cast(e as double)+6e-1)*2e2))) as int))",
    },
}

#: name -> (table, text)
VIEWS = {
    "v_candidates": ("events", """
        select user_id as video_id, event_id as frame_id, {US}/1e6 as t_sec,
        row_number() over (partition by user_id order by ts, event_id) as frame_seq,
        case event_type when 'view' then 'standing' when 'click' then 'sitting' when 'purchase' then 'squatting' when 'signup' then 'closeup' end as pose_label,
        cast(regexp_extract(props, '[0-9]+', 0) as int) as k,
        case cast(regexp_extract(props, '[0-9]+', 0) as int) % 11 when 0 then 'front' when 1 then 'looking_left' when 2 then 'looking_right' when 3 then 'profile_left' when 4 then 'profile_right' when 5 then 'looking_up' when 6 then 'looking_down' when 7 then 'looking_up_left' when 8 then 'looking_up_right' when 9 then 'looking_down_left' else 'looking_down_right' end as direction,
        cast(event_id % 3 as int) as position_id,
        least(1e0, value/2e2) as quality, cast(regexp_extract(props, '[0-9]+', 0) as int)/1e2 as conf
        from events"""),
    "v_detections": ("lineitem", """
        select l_orderkey % 50 as video_id, l_orderkey as frame_id,
        case when l_linenumber % 2 = 1 then 'face' else 'body' end as kind,
        row_number() over (partition by l_orderkey, l_linenumber % 2 order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as idx,
        cast(l_partkey * 37 % 1200 as int) as x1, cast(l_suppkey * 53 % 500 as int) as y1,
        cast(l_partkey * 37 % 1200 as int) + case when l_linenumber % 2 = 1 then 20 + 3*cast(l_quantity as int) else 300 + 8*cast(l_quantity as int) end as x2,
        cast(l_suppkey * 53 % 500 as int) + case when l_linenumber % 2 = 1 then 25 + 4*cast(l_quantity as int) else 250 + 6*cast(l_quantity as int) end as y2,
        2e-1 + 7*l_discount as conf, 1920 as width, 1080 as height from lineitem"""),
    "v_headpose": ("embeddings", """
        select vec_id, label, {E52}*5e2 as yaw, {E53}*2e2 as pitch, {E54}*1.5e2 as roll, least(1e0, abs({E55})*4+3e-1) as conf from embeddings"""),
    "v_raster": ("embeddings", """
        select vec_id, label, 8 as width, 8 as height, {RASTER} as px from embeddings"""),
    "v_keypoints": ("embeddings", """
        select e.vec_id, b.kp, b.x0 + 3e2*{EI0} as x, b.y0 + 3e2*{EI1} as y, least(1e0, 35e-2 + 6*abs({EI2})) as conf from embeddings e cross join (values ('nose',0,900,150),('left_eye',1,910,135),('right_eye',2,890,135),('left_ear',3,925,145),('right_ear',4,875,145),('left_shoulder',5,980,260),('right_shoulder',6,820,260),('left_elbow',7,1010,380),('right_elbow',8,790,380),('left_wrist',9,1020,490),('right_wrist',10,780,490),('left_hip',11,950,520),('right_hip',12,850,520),('left_knee',13,950,720),('right_knee',14,850,720),('left_ankle',15,950,920),('right_ankle',16,850,920)) as b(kp,i,x0,y0)"""),
    "v_videos": ("customer", """
        select c_custkey as video_id, 10e0 + c_custkey % 120 as duration, case c_custkey % 3 when 0 then 24e0 when 1 then 25e0 else 30e0 end as fps,
        cast(floor((10e0 + c_custkey % 120) * case c_custkey % 3 when 0 then 24e0 when 1 then 25e0 else 30e0 end) as int) as total_frames, 1920 as width, 1080 as height from customer"""),
    "v_probe": ("orders", """
        select o_custkey as video_id, (o_orderkey % 520)/4e0 as pts, case when o_orderkey % 4 = 0 then 'I' when o_orderkey % 4 = 1 then 'B' else 'P' end as pict_type from orders"""),
}


def text(name: str, dialect: str) -> str:
    out = VIEWS[name][1]
    for word, value in _WORDS[dialect].items():
        out = out.replace(word, value)
    return out


def load(spark: SparkSession, sf_dir: str, name: str, by: str | None = None) -> DataFrame:
    """A view, or a table of that name. by: a column that its table is dealt by first, so that windows and groups within its values need no shuffle of their own."""
    rows = spark.read.parquet(f"{sf_dir}/{VIEWS[name][0] if name in VIEWS else name}.parquet")
    if by:
        rows = rows.repartition(by)
    if name not in VIEWS:
        return rows
    source = VIEWS[name][0]
    return spark.sql(text(name, "spark").replace(f"from {source}", "from {source}", 1), source=rows)


def duck(sql: str, *names: str) -> str:
    """A DuckDB query with the views it names in front."""
    heads = [f"{n} as ({text(n, 'duckdb')})" for n in names]
    return "with " + ", ".join(heads) + (", " if sql.lstrip().lower().startswith("with ") else " ") + (sql.lstrip()[5:] if sql.lstrip().lower().startswith("with ") else sql)
