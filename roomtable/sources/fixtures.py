"""Views that stand for corpus tables, over the parquet tables at hand.

One text per view; the same text runs in Spark and, as part of a check, in any
SQL engine. Where the two dialects differ there are two texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_SPARK_ONLY: dict[str, str] = {
    "cell": """
        select vec_id as photo_id, pos div 8 as y, cast(pos % 8 as bigint) as x, least(1D, greatest(0D, 0.5D + cast(v as
        double))) as luma, v > 0 as m from embeddings lateral view posexplode(embedding) e as pos, v
    """,
    "sheet": """
        select vec_id div 50 as photo_id, vec_id % 50 as y, cast(pos as bigint) as x, least(1D,
        greatest(0D, 0.5D + cast(v as double))) as luma, v > 0.05 as m from embeddings lateral view
        posexplode(embedding) e as pos, v
    """,
}

_CHECK_ONLY: dict[str, str] = {
    "cell": """
        select vec_id as photo_id, (i - 1) // 8 as y, (i - 1) % 8 as x, least(1, greatest(0, 0.5 +
        embedding[i]::double)) as luma, embedding[i] > 0 as m from embeddings, range(1, 65) r(i)
    """,
    "sheet": """
        select vec_id // 50 as photo_id, vec_id % 50 as y, i - 1 as x, least(1, greatest(0, 0.5 +
        embedding[i]::double)) as luma, embedding[i] > 0.05 as m from embeddings, range(1, 65) r(i)
    """,
}

_COMMON: dict[str, str] = {
    "photo": """
        select d.doc_id as photo_id, case d.lang when 'en' then 'easy' when 'fr' then 'medium' when 'de'
        then 'hard' else 'rejected' end as difficulty, case when d.doc_id % 5 = 0 then 'public/' else
        'private-real/' end || cast(d.doc_id as string) as file, d.source, case d.doc_id % 11 when 0
        then '' when 1 then 'inconnue' when 2 then 'TBD' else 'CC0' end as license, d.doc_id % 7 = 0 as
        redistributable, case when d.doc_id % 14 = 0 then 'redistributable' else 'local_evaluation_only'
        end as usage, SHA256(d.text) as digest, case when d.doc_id % 13 = 0 then null when d.doc_id % 17
        = 0 then SHA256(d.source) else SHA256(d.text) end as expected_digest, l.doc_id is not null as
        graded, case when d.doc_id % 10 = 0 then 'golden_holdout' else 'pilot_development' end as split,
        case when d.doc_id % 10 = 0 or d.doc_id % 97 = 0 then case d.doc_id % 9 when 0 then
        'wall_floor_hard' when 1 then 'thin_occluders' when 2 then 'strong_perspective' when 3 then
        'opening' when 4 then 'wood_on_wood' else null end end as golden_case from documents d left join
        labels l on d.doc_id = l.doc_id
    """,
    "photo_trait": """
        select doc_id as photo_id, 'furnished' as trait from documents where n_chars > 1000 union all
        select doc_id, 'corridor' from documents where doc_id % 3 = 0 union all select doc_id, 'rug'
        from documents where lang = 'fr' union all select doc_id, 'small_room' from documents where
        n_chars < 300
    """,
    "emission": """
        select doc_id as photo_id, 'expected' as side, 'image_blurry' as code from labels where quality
        = 0 union all select doc_id, 'expected', 'image_too_dark' from labels where toxic = 1 union all
        select doc_id, 'expected', 'image_too_small' from documents where n_chars < 200 union all select
        doc_id, 'detected', 'image_too_small' from documents where n_chars < 260 union all select
        doc_id, 'detected', 'image_blurry' from documents where text like '%***%' or doc_id % 19 = 0
        union all select doc_id, 'detected', 'image_too_dark' from documents where doc_id % 6 = 0 union
        all select doc_id, 'detected', 'lens_analysis_undetermined' from documents where doc_id % 4 = 0
    """,
    "pass": """
        select conv_id as photo_id, turn, case when turn = 0 then null else chr(cast(64 + turn as int))
        end as pass_label, role as annotator, (conv_id * 8 + turn) % (select count(*) from
        embeddings) as vec_id, case (conv_id +
        turn) % 3 when 0 then 'draft' when 1 then 'reviewed' else 'approved' end as status, case when
        (conv_id + turn) % 3 = 0 then null when conv_id % 2 = 0 then role else 'reviewer' end as
        reviewer, turn % 2 = 0 as independent_pass, case when turn % 4 = 3 then null else
        cast(length(text) as double) end as first_pass_seconds, case when turn % 2 = 1 then 30.0e0 else
        0.0e0 end as review_seconds from conversations
    """,
    "label_map": """
        select photo_id, y, x, cast(floor(luma * 30) as int) as class_id from sheet
    """,
    "track_point": """
        select cast(floor(photo_id / 5) as bigint) as photo_id, photo_id as track_id, case when photo_id
        % 2 = 0 then 'vertical' else 'horizontal' end as orientation, y * 8 + x as scan, 32 + (photo_id
        % 5 - 2) * 12 + (luma - 0.5) * 4 as across from cell
    """,
    "segment": """
        select photo_id, cast(floor((y * 8 + x) / 4) as bigint) as seg_id, max(case when x % 4 = 0 then
        luma * 1000 end) as x0, max(case when x % 4 = 1 then luma * 1000 end) as y0, max(case when x % 4
        = 2 then luma * 1000 end) as x1, max(case when x % 4 = 3 then luma * 1000 end) as y1 from cell
        group by photo_id, cast(floor((y * 8 + x) / 4) as bigint)
    """,
    "stage_timing": """
        select event_id as run_id, event_type as stage, case when event_id % 23 = 0 then null else value
        end as ms, ts from events
    """,
    "product": """
        select p_partkey as ref, p_name as name, p_brand as species, case p_size % 3 when 0 then 'lames'
        when 1 then 'point-de-hongrie' else 'baton-rompu' end as pattern, p_size * 5 as width_mm,
        cast(floor(p_retailprice) as int) as length_mm, case p_type when 'ECONOMY' then 'Huilé blanchi'
        when 'STANDARD' then 'Verni mat' when 'PROMO' then 'Fumé brossé' else 'Satiné' end as finish,
        case p_partkey % 4 when 0 then 'clair' when 1 then 'naturel' when 2 then 'chaud' else 'fonce'
        end as tone from part
    """,
    "plane": """
        select r_regionkey as plane_ref, 0.1e0 * r_regionkey as far_y, 4.0e0 + r_regionkey as width_m,
        case when r_regionkey = 3 then 0.0e0 else 3.0e0 end as depth_m from region
    """,
    "zone": """
        select n_nationkey as zone_id, n_nationkey % 4 as scene_id, case when n_nationkey % 8 = 5 then
        99 when n_nationkey % 8 = 6 then null else n_regionkey end as plane_ref, 24 - n_nationkey as ord
        from nation
    """,
    "exclusion": """
        select vec_id as photo_id, label as k, case label % 6 when 0 then 'occluder' when 1 then
        'floor_covering' when 2 then 'structural' when 3 then 'opening' when 4 then 'other' else
        'unknown' end as role, (vec_id % 5) / 10.0e0 as x0, (vec_id % 7) / 10.0e0 as y0, (vec_id % 5) /
        10.0e0 + 0.1e0 + (label % 4) / 10.0e0 as x1, (vec_id % 7) / 10.0e0 + 0.25e0 as y1 from
        embeddings
    """,
    "draw": """
        select event_id as draw_id, '{"schema":"' || case when event_id % 11 = 0 then 'draw@0' else
        'draw@1' end || '","photoId":' || cast(user_id as string) || case when event_id % 13 = 0 then ''
        else ',"width":640,"height":480' end || ',"floorPolygons":' || case when event_id % 17 = 0 then
        '[]' else '[[{"x":0.0,"y":0.6},{"x":1.0,"y":0.6},{"x":1.0,"y":1.2}]]' end ||
        ',"floorHoles":[[{"x":0.1,"y":0.7},{"x":0.2,"y":0.7},{"x":0.2,"y":0.8}]],"uncertainZones":' ||
        case when event_id % 3 = 0 then
        '[{"reason":"reflection","polygon":[{"x":0.3,"y":0.7},{"x":0.4,"y":0.7},{"x":0.4,"y":0.8}]}]' else '[]' end ||
        ',"boundary":[{"kind":"wall_floor","points":[{"x":0.0,"y":0.6},{"x":1.0,"y":0.6}]}]' ||
        ',"floorHoleRoles":["occluder"],"drawSeconds":' || cast(event_id % 300 as string) || '}' as body
        from events
    """,
}

_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

#: Text of every view for the checks, in an order where each view comes after
#: the ones it reads.
SQL_VIEWS: dict[str, str] = {
    name: " ".join(text.split())
    for name, text in {**_CHECK_ONLY, **_COMMON}.items()
}


class Fixtures:
    """Lazily built views of one data folder: `fx.cell`, `fx.photo`, ..."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self._built: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name in _TABLES:
            return self.table(name)
        if name not in self._built:
            text = {**_COMMON, **_SPARK_ONLY}[name].replace("SHA256(d.text)", "sha2(d.text, 256)")
            text = text.replace("SHA256(d.source)", "sha2(d.source, 256)")
            text = " ".join(text.replace("{", "{{").replace("}", "}}").split())
            inputs: dict[str, DataFrame] = {}
            for source in (*_TABLES, *SQL_VIEWS):
                marked = re.sub(rf"\b(from|join) {source}\b", rf"\1 {{{source}}}", text)
                if marked != text:
                    inputs[source] = self.view(source)
                    text = marked
            self._built[name] = self.spark.sql(text, **inputs)
        return self._built[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.view(name)
