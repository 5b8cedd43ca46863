"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classlm import class_scores
from .counting import token_counts
from .importance import importance
from .mixing import mixture
from .neardup import near_duplicates
from .neighbours import nearest
from .packing import packed
from .phrases import collocations
from .repeats import repeated_windows
from .resampling import resampled
from .rules import STATISTICS, quality_rules
from .tables import documents, new_folder
from .tokens import read_token_files, write_token_files
from .urls import url_verdicts

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
COUNTED = public_tokenizers.path("byte_bpe_50k.json")
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows(documents(spark, sf_dir), window=20).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    write_token_files(documents(spark, sf_dir), folder, TOKENIZER, end=1)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *STATISTICS, "base_failed", "kept", "anomaly")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(documents(spark, sf_dir))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), RULES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), TOKENIZER, end=2, size=4096)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), COUNTED, limit=1024)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir), least=30, top=2000)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_substring_dedup, op3_quality_classifier, op4_token_ids, op5_quality_rules,
        op6_lm_scoring, op7_url_filters, op8_packing, op9_mixing, op10_nearest_neighbours,
        op11_token_counts, op12_phrase_collocations, op13_importance_resampling,
    )
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT p.a, p.b FROM both_ p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least_ AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept FROM documents d JOIN least_ l ON l.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op2_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS words FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20) y),
d AS (SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1 AS again FROM v),
g AS (SELECT x.doc_id, x.i, x.word, max(CASE WHEN d.again THEN 1 ELSE 0 END) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM x LEFT JOIN d ON d.doc_id = x.doc_id AND d.i = x.i),
t AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.n_words, 0) AS n_words, coalesce(t.n_removed, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256 FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op12_phrase_collocations": f"""
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
k AS (SELECT unnest([1, 2, 3, 4]) AS k),
x AS (SELECT id, lang, unnest(ws) AS a, unnest(range(len(ws))) AS i FROM w),
y AS (SELECT lang, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d FROM x WINDOW o AS (PARTITION BY id ORDER BY i)),
g AS (SELECT lang, 1 AS k, a AS phrase FROM y UNION ALL SELECT lang, 2, a || ' ' || b FROM y WHERE b IS NOT NULL UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM y WHERE c IS NOT NULL
  UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d FROM y WHERE d IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, c.a, j.k AS j, x.a AS l, y.a AS r, CAST(2000000 * c.a::HUGEINT // (x.a + y.a) AS BIGINT) AS score FROM c JOIN k j ON j.k < c.k
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j.k + 1:], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
part AS (SELECT c.lang, array_to_string(c.ws[s.i:s.i + z.k - 1], ' ') AS phrase, max(c.a) AS most FROM c JOIN k z ON z.k > 1 AND z.k < c.k JOIN (SELECT unnest([1, 2, 3]) AS i) s ON s.i + z.k - 1 <= c.k GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN part ON part.lang = low.lang AND part.phrase = low.phrase WHERE part.most IS NULL OR 100 * part.most < 80 * low.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN total ON total.lang = kept.lang QUALIFY rank <= 2000""",
}
