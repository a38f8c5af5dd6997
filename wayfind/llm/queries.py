"""One query for each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op4_media
from .op1_warc import archive, read
from .op2_substring import repeated_passages
from .op3_minhash import near_duplicates

from .op5_pii import find
from .op6_quality import quality
from .op7_html import extract
from .op8_mixing import mix
from .op9_toxicity import toxicity
from .op10_decontaminate import decontaminate
from .storage import table


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(archive(table(spark, sf_dir, "pages")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_media.describe(op4_media.store(table(spark, sf_dir, "documents")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archive": op1_warc_archive,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_media_columns": op4_media_columns,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_html_extract": op7_html_extract,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_decontaminate": op10_decontaminate,
}

SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
        h AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM s),
        r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) > 1 AS late FROM h),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r WHERE late),
        x AS (SELECT d.doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
        k AS (SELECT x.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.p = g.p WHERE g.p IS NULL GROUP BY x.doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    "op3_minhash_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS t FROM d),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
        e2 AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
        r AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT e2.y, r.root FROM r JOIN e2 ON r.doc_id = e2.x),
        m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
        SELECT m.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id, m.root = m.doc_id AS kept FROM m LEFT JOIN n ON m.doc_id = n.doc_id""",
    "op1_warc_archive": r"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
        m AS (SELECT t, max(page_id) AS best FROM p GROUP BY t),
        b AS (SELECT p.page_id, url, strlen(p.t)::BIGINT AS n, m.best,
            translate(array_to_string(list_transform(range(0, 8), lambda i: lpad(to_base(('0x' || substr(h, 5 * i + 1, 5))::BIGINT, 32), 4, '0')), ''),
                '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS d FROM p JOIN m ON p.t = m.t),
        k AS (SELECT *, page_id <> best AS again, 73 + strlen(n::VARCHAR) + 4 AS http FROM b)
        SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN again THEN best END AS refers_to,
            (10 + CASE WHEN again THEN 20 ELSE 21 END + 65 + 19 + strlen(coalesce(url, '')) + 33 + 60
                + CASE WHEN again THEN 80 + 65 ELSE 0 END + 50 + 18 + strlen((http + CASE WHEN again THEN 0 ELSE n END)::VARCHAR) + 2 + http
                + CASE WHEN again THEN 0 ELSE n END + 4)::BIGINT AS record_bytes,
            true AS verified FROM k""",
    "op8_mixing": r"""
        WITH b AS (SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
            -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|mix'), 1, 13))::BIGINT + 5e-1) / 4503599627370496e0)
                / coalesce(5e-2 + 95e-2 * length(translate(text, '0123456789!#$%&*|=+<>@^_~', '')) / nullif(length(text), 0), 1e0) AS key FROM documents),
        s AS (SELECT none, source, sum(size)::BIGINT AS source_size FROM b GROUP BY none, source),
        w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY none, source) - 1) % 3 + 1)::INT] AS weight, 2e0 * source_size AS cap FROM s),
        f AS (SELECT *, row_number() OVER o AS rank, 15e-1 * sum(source_size) OVER () - sum(cap) OVER (o ROWS UNBOUNDED PRECEDING) + cap AS left_words,
            sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight FROM w WINDOW o AS (ORDER BY cap / weight, none, source)),
        g AS (SELECT *, left_words / rest_weight AS level FROM f),
        i AS (SELECT min(rank) AS first FROM g WHERE cap / weight >= level),
        t AS (SELECT none, source, source_size, CASE WHEN rank < coalesce(first, 1e9) THEN cap ELSE least((SELECT level FROM g, i WHERE rank = first) * weight, cap) END AS target FROM g, i),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
        d AS (SELECT b.*, source_size, target, epochs, round(target - epochs * source_size) AS rest, sum(size) OVER (PARTITION BY b.none, b.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
            FROM b JOIN e ON b.none = e.none AND b.source = e.source)
        SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken, epochs::INT AS epochs FROM d""",
}
