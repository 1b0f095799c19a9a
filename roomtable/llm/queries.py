"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomtable.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def reachable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package; a cluster has it installed."""
    if spark.sparkContext.master.startswith("local"):
        root = str(Path(__file__).resolve().parents[2])
        paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
        if root not in paths:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def query(name: str, sql: str | None = None):
    def keep(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            reachable(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return build

    return keep


@query("op7_simhash_near_copies")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomtable.llm.near_copies import near_copies

    return near_copies(table(spark, sf_dir, "documents"))


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomtable.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_benchmark_leaks")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomtable.llm.leaks import benchmark_leaks

    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_personal_data")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomtable.llm.personal import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomtable.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"))


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomtable.llm.idfiles import written_and_read

    return written_and_read(table(spark, sf_dir, "documents"))


@query("op3_backoff_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomtable.llm.backoff import language_scores

    return language_scores(table(spark, sf_dir, "documents"))


@query("op1_nearest_page_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomtable.llm.pagediff import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


@query("op2_licence_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomtable.llm.licences import licences

    return licences(table(spark, sf_dir, "documents"))


@query("op9_tool_call_chat")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomtable.llm.toolcalls import chat_lines

    return chat_lines(table(spark, sf_dir, "conversations"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "op11_line_runs",
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS place,
                      string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT r, place, i, lines[i] AS line,
                 translate(trim(lines[i], {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
          FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
    k AS (SELECT key, min(place) AS owner FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT place) > 1),
    f AS (SELECT l.r, l.i, l.line, coalesce(l.place > k.owner, false) AS gone FROM l LEFT JOIN k ON l.key = k.key),
    t AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
                 coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM f GROUP BY r)
    SELECT d.doc_id, t.n_lines, t.n_dropped, sha256(t.kept) AS kept_sha256 FROM t JOIN d ON d.r = t.r
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomtable.llm.line_runs import without_repeated_lines

    kept = without_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op12_collocations",
    r"""
    WITH p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
    n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
    f AS MATERIALIZED (SELECT lang, ph, count(*) AS f FROM (
        SELECT lang, w[i:i + m - 1] AS ph FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, range(1, 6) AS l(m)))
      GROUP BY lang, ph HAVING count(*) >= 100),
    c AS (SELECT f.lang, f.ph, f.f AS a, k, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * f.f * n.n) // (x.f::HUGEINT * y.f) AS score
      FROM (SELECT *, unnest(range(1, len(ph))) AS k FROM f) AS f
      JOIN f AS x ON x.lang = f.lang AND x.ph = f.ph[1:k] JOIN f AS y ON y.lang = f.lang AND y.ph = f.ph[k + 1:] JOIN n ON n.lang = f.lang
      QUALIFY row_number() OVER (PARTITION BY f.lang, f.ph ORDER BY score, k) = 1),
    s AS (SELECT DISTINCT e.lang, e.ph FROM (
        SELECT lang, f, ph AS whole, ph[i:i + m - 1] AS ph FROM (SELECT *, unnest(range(1, len(ph) - m + 2)) AS i FROM f, range(2, 5) AS l(m) WHERE m < len(ph))) AS e
      JOIN f ON f.lang = e.lang AND f.ph = e.ph WHERE 100 * e.f >= 100 * f.f)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
    FROM (SELECT *, array_to_string(ph, ' ') AS phrase FROM c ANTI JOIN s ON s.lang = c.lang AND s.ph = c.ph) QUALIFY rank <= 2000
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomtable.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def _means_sql(rounds: int = 5) -> str:
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS q
           FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        """c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), q) - 1 AS c, q
           FROM v WHERE vec_id IS NOT NULL QUALIFY c < 40)""",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (SELECT * FROM (
              SELECT v.r, v.vec_id, v.q, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))) AS d
              FROM v, c{k} AS c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        )
        if k < rounds:
            steps.append(
                f"""c{k + 1} AS MATERIALIZED (SELECT c{k}.c, coalesce(m.q, c{k}.q) AS q FROM c{k} LEFT JOIN (
                  SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY i) AS q FROM (
                    SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(q) AS x FROM a{k}) GROUP BY c, i)
                  GROUP BY c) AS m ON m.c = c{k}.c)"""
            )
    return f"""WITH {", ".join(steps)}
    SELECT a.vec_id, a.c::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
           (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
    FROM a{rounds} AS a JOIN c{rounds} AS c ON c.c = a.c"""


@query("op13_pivot_clusters", _means_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomtable.llm.pivots import clustered

    return clustered(table(spark, sf_dir, "embeddings"))
