"""Building blocks of the checking SQL (common table expressions)."""

from __future__ import annotations

from fieldtide.constants import (
    ASSETS, BANDS, COVERAGE_KEYS, DAYS_IN_SERIES, DAYS_PER_BUCKET, OTHER_CROPS, SCL_DROP,
    TARGETED_CROPS,
)
from fieldtide.sources.derived import AOI_LINES, CLASS_BY_KEY

KEY = 'bbox, "year", lon, lat, CDL'
BAND_LIST = ", ".join(BANDS)
ORDER = f"scene_date, tile, {BAND_LIST}, scl"


def strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_CLASS = f"{strings(CLASS_BY_KEY)}[(l_suppkey % 16 + 1)::INTEGER]"

_BANDS = ",\n  ".join(
    f"((l_orderkey*{k + 7} + l_partkey*{k + 13} + l_linenumber*101 + {(k + 1) * 997}) % 10000)"
    f"::INTEGER AS {b}" for k, b in enumerate(BANDS))

OBS = f"""obs AS (SELECT {_CLASS} AS CDL,
  -90.6e0 + (l_suppkey % 100)*0.0003e0 AS lon, 35.5e0 + (l_suppkey // 100)*0.0003e0 AS lat,
  ((l_orderkey + l_partkey*5 + l_linenumber*7) % 12)::INTEGER AS scl,
  {_BANDS},
  concat_ws(',', (390000 + (l_suppkey % 4)*20000)::VARCHAR, (1100000 + (l_suppkey % 4)*30000)::VARCHAR,
    (410000 + (l_suppkey % 4)*20000)::VARCHAR, (1130000 + (l_suppkey % 4)*30000)::VARCHAR) AS bbox,
  year(l_shipdate)::INTEGER AS "year",
  '15SY' || substr('UVWXYZT', l_linenumber, 1) || '_' || (l_linenumber % 2)::VARCHAR AS tile,
  l_shipdate::DATE AS scene_date FROM lineitem)"""

MASKED = f"masked AS (SELECT * FROM obs WHERE scl NOT IN ({', '.join(map(str, SCL_DROP))}))"

#: Numbered images of the masked series.
IMG = f"""img AS (SELECT *,
  (row_number() OVER (PARTITION BY {KEY} ORDER BY {ORDER}) - 1) AS seq,
  (scene_date - min(scene_date) OVER (PARTITION BY {KEY}))::INTEGER AS "day",
  count(*) OVER (PARTITION BY {KEY}) AS num_images,
  (max(scene_date) OVER (PARTITION BY {KEY}) - min(scene_date) OVER (PARTITION BY {KEY}))::INTEGER AS last_day,
  (min(scene_date) OVER (PARTITION BY {KEY}) - DATE '1970-01-01')::INTEGER AS first_day
  FROM masked)"""

_GAPS = ", ".join(
    f"CASE WHEN (CASE day(scene_date) % 4 WHEN 0 THEN 5 WHEN 1 THEN 10 ELSE 13 END) > {i} "
    f"THEN {a}::DOUBLE END AS {a}" for i, a in enumerate(ASSETS))
GAPS = f"gaps AS (SELECT CDL, lon, lat, {_GAPS}, bbox, \"year\", tile, scene_date FROM obs)"

SCENES = f"""scenes AS (SELECT
  'S2A_15SY' || substr('UVWXYZ', (user_id % 6 + 1)::INTEGER, 1) || '_' || strftime(ts, '%Y%m%d') || '_'
    || (event_id % 3)::VARCHAR || '_L2A' AS id,
  event_id AS seq, ts AS datetime, replace(props, '"k"', '"{COVERAGE_KEYS[0]}"') AS properties, user_id,
  -91e0 + (user_id % 20)*0.05e0 AS min_lon, 35e0 + (user_id % 10)*0.05e0 AS min_lat,
  -91e0 + (user_id % 20)*0.05e0 + 0.1e0 AS max_lon, 35e0 + (user_id % 10)*0.05e0 + 0.1e0 AS max_lat
  FROM events)"""

CELLS = ('cells AS (SELECT p_partkey // 50 AS "row", p_partkey % 50 AS col, '
         "(p_size % 12)::INTEGER AS code FROM part)")

LEGEND = ("legend AS (SELECT i::INTEGER AS \"Codes\", CASE WHEN i < 10 THEN "
          f"{strings(CLASS_BY_KEY)}[(i + 1)::INTEGER] END AS \"Class_Names\", (i*20)::INTEGER AS \"ESRI_Red\", "
          "(255 - i*20)::INTEGER AS \"ESRI_Green\", (i*7)::INTEGER AS \"ESRI_Blue\" FROM range(12) t(i))")

_W = [f"(1 + (h*{i + 3} + {i * i * 11}) % 97)" for i in range(7)]
SCORES = f"""scores AS (SELECT h, l_orderkey, l_partkey, l_suppkey AS pixel_id,
  -90.6e0 + (l_suppkey % 100)*0.0003e0 AS longitude, 35.5e0 + (l_suppkey // 100)*0.0003e0 AS latitude,
  {_CLASS} AS raw_cdl, (l_linenumber*30 - 15)::INTEGER AS start_day,
  ((l_suppkey % 7 + CASE WHEN h % 5 = 0 THEN 1 ELSE 0 END) % 7)::INTEGER AS true_label,
  [{', '.join(f"{w}::DOUBLE/({'+'.join(_W)})::DOUBLE" for w in _W)}] AS probs
  FROM (SELECT *, l_orderkey*31 + l_partkey*17 + l_linenumber*7 AS h FROM lineitem))"""

#: Scored rows with prediction, confidence and date.
RESULTS = """results AS (SELECT *, (list_position(probs, list_max(probs)) - 1)::INTEGER AS prediction,
  list_max(probs) AS confidence_score,
  (DATE '2021-01-01' + (start_day + 120 - 1)::INTEGER) AS prediction_date FROM scores)"""

AOI = f"""aoi AS (SELECT DISTINCT line, split_part(v, '|', 1) AS name,
  regexp_replace(split_part(v, '|', 2), '\\s', '', 'g') AS bbox,
  trim(unnest(string_split(split_part(v, '|', 3), ',')))::INTEGER AS "year"
  FROM (SELECT unnest({strings(AOI_LINES)}) AS v, unnest(range({len(AOI_LINES)})) AS line)
  WHERE v NOT LIKE '#%')"""


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def base_label(cdl: str = "CDL") -> str:
    return (f"CASE WHEN list_contains({strings(TARGETED_CROPS)}, {cdl}) "
            f"THEN list_position({strings(TARGETED_CROPS)}, {cdl}) + 2 "
            f"WHEN list_contains({strings(OTHER_CROPS)}, {cdl}) THEN 1 ELSE 0 END")


#: Seeded hash that orders images at random.
IMAGE_RANK = ("('0x' || substr(md5(concat_ws('|', '42', \"day\"::VARCHAR, tile, scl::VARCHAR, concat_ws(',', "
              + ", ".join(f"{b}::VARCHAR" for b in BANDS) + "))), 1, 8))::BIGINT, seq")


def windows(
    start: str = "0", days: str = str(DAYS_IN_SERIES), bucket: str = str(DAYS_PER_BUCKET),
    frames: str = "2", cap: str | None = None, source: str = "img", extra: str = "",
    where: str = "TRUE", pick: str = "seq",
) -> list[str]:
    """CTEs `picks` (first image per bucket) and `labels` (one row per window).

    start, days, bucket and frames are SQL over the image columns; `extra` names
    sweep columns that join the window key.
    """
    more = f", {extra}" if extra else ""
    win = f'{KEY}{more}, start_day'
    capped = f"WHERE n <= {cap}" if cap else ""
    return [
        f"""starts AS (SELECT DISTINCT {KEY}{more}, ({start})::INTEGER AS start_day,
  ({frames})::INTEGER AS frames FROM {source} WHERE {where})""",
        f"""inside AS (SELECT *, row_number() OVER (PARTITION BY {win} ORDER BY {pick}) AS n FROM
  (SELECT *, ({start})::INTEGER AS start_day, ({bucket})::INTEGER AS width, ({days})::INTEGER AS span
   FROM {source} WHERE {where}) WHERE "day" BETWEEN start_day AND start_day + span)""",
        f"""kept AS (SELECT * FROM inside {capped})""",
        f"""placed AS (SELECT *, greatest(0, least("day" - min("day") OVER (PARTITION BY {win}), 365)) AS rday
  FROM kept)""",
        f"""picks AS (SELECT *, rday // width AS bucket FROM placed
  QUALIFY row_number() OVER (PARTITION BY {win}, rday // width ORDER BY seq) = 1)""",
        f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {win} ORDER BY bucket DESC) AS back FROM picks
  WHERE scl <> 0)""",
        f"""seen AS (SELECT {win}, count(*) AS buckets, bool_or(scl = 4 AND back <= frames0) AS veg
  FROM (SELECT *, ({frames})::INTEGER AS frames0 FROM ranked) GROUP BY ALL)""",
        f"""labels AS (SELECT s.*, coalesce(v.buckets, 0) AS buckets, v.veg,
  (CASE WHEN ({base_label('s.CDL')}) <> 0 AND NOT v.veg THEN 2 ELSE {base_label('s.CDL')} END)::INTEGER AS label
  FROM starts s LEFT JOIN seen v USING ({win}))""",
    ]


NO_DOUBLE = "CDL NOT LIKE '%Dbl%'"
SERIES_CTES = [OBS, MASKED, IMG]

#: The four index channels over band columns.
INDEX_SQL = {
    "ndvi": "trunc(greatest(least((nir::DOUBLE - red::DOUBLE)/(nir::DOUBLE + red::DOUBLE + 1e-6), 1e0), -1e0)*100)::BIGINT",
    "evi": "trunc((nir::DOUBLE - red::DOUBLE)*2.5e0/(nir::DOUBLE + red::DOUBLE*6e0 - blue::DOUBLE*7.5e0 + 1e0 + 1e-6)*100e0)::BIGINT",
    "ndwi": "trunc((nir::DOUBLE - swir16::DOUBLE)/(nir::DOUBLE + swir16::DOUBLE + 1e-6)*100e0)::BIGINT",
    "ndbi": "trunc((swir16::DOUBLE - nir::DOUBLE)/(swir16::DOUBLE + nir::DOUBLE + 1e-6)*100e0)::BIGINT",
}
INDEX_LIST = ", ".join(f"{e} AS {n}" for n, e in INDEX_SQL.items())
