"""Queries on text, JSON, identities, hashes and split rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions import ports as P
from matchloom.functions import text as X
from matchloom.operators.ordering import ordered_hashes, positions
from matchloom.operators.records import batch_progress, item_binding
from matchloom.sources import records as S
from matchloom.sources.tables import written

from . import bindings as B
from . import sql as Q
from .registry import query


@query(f"""WITH {Q.PRIM}, r AS (SELECT step, ordinal, CASE WHEN ordinal % 5 = 4 THEN 'blob' ELSE ' ' || upper(kind) || ' ' END AS raw, CASE WHEN step % 11 = 0 THEN 3 ELSE members END AS m FROM prim)
  SELECT step, ordinal, CASE WHEN lower(trim(raw)) NOT IN ('face', 'edge') THEN 'kind' WHEN m > 2 THEN 'symmetry' ELSE 'valid' END AS status,
    CASE WHEN lower(trim(raw)) IN ('face', 'edge') AND m <= 2 THEN lower(trim(raw)) END AS kind FROM r""")
def p03_normalize_contract(spark, sf):
    raw = F.when(F.col("ordinal") % 5 == 4, "blob").otherwise(F.concat(F.lit(" "), F.upper("kind"), F.lit(" ")))
    symmetry = F.when(F.col("step") % 11 == 0, "thrice").otherwise(P.symmetry_class(F.col("members")))
    kind = F.lower(F.trim(raw))
    status = F.when(~kind.isin(P.PRIMITIVE_KINDS), "kind").when(~F.lower(F.trim(symmetry)).isin(P.SYMMETRY_CLASSES), "symmetry").otherwise("valid")
    return B.primitives(spark, sf).select("step", "ordinal", status.alias("status"), F.when(status == "valid", kind).alias("kind"))


_NAMED = " OR ".join(f"contains(t, '{x}')" for x in X.FORBIDDEN_TOKENS)


@query(f"""SELECT doc_id, {_NAMED} AS named FROM (SELECT doc_id, replace(replace(lower(text || CASE WHEN doc_id % 7 = 0 THEN ' Use Candidate-ID 7.' ELSE '' END), '-', '_'), ' ', '_') AS t FROM documents) x""")
def p14_forbidden_identity_scan(spark, sf):
    text = F.concat("text", F.when(F.col("doc_id") % 7 == 0, " Use Candidate-ID 7.").otherwise(""))
    return B.table(spark, sf, "documents").select("doc_id", X.names_identity(text).alias("named"))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 6 = 0 THEN 'error' ELSE 'parsed' END AS status FROM events""")
def p15_decode_response(spark, sf):
    body = F.when(F.col("event_id") % 6 == 0, F.lit("no json")).otherwise(F.col("props"))
    value = X.strict_object(X.unfenced(F.concat(F.lit("```json\n"), body, F.lit("\n```\n"))))
    k = F.try_variant_get(value, "$.k", "bigint")
    return B.table(spark, sf, "events").select("event_id", k.alias("k"), F.when(value.isNull(), "error").otherwise("parsed").alias("status"))


@query(r"""WITH s AS (SELECT conv_id, turn, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM conversations),
  p AS (SELECT conv_id, turn, unnest(range(0, len(parts))) AS pos, unnest(parts) AS part FROM s),
  c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1 AS pos, regexp_replace(part, '^\s+|\s+$', '', 'g') AS part FROM p WHERE regexp_replace(part, '^\s+|\s+$', '', 'g') <> '')
  SELECT conv_id, turn, CAST(min(pos) AS INTEGER) AS first, string_agg(part, ' ' ORDER BY pos) AS clause FROM c WHERE contains(part, 'the') AND contains(part, 'of') GROUP BY conv_id, turn""")
def p16_sentence_clauses(spark, sf):
    parts = B.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(X.sentences(F.col("text"))).alias("pos", "part"))
    both = parts.where(F.contains("part", F.lit("the")) & F.contains("part", F.lit("of")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"])
    return both.groupBy("conv_id", "turn").agg(F.min("pos").alias("first"), F.array_join(ordered, " ").alias("clause"))


_DIGIT = "(instr('0123456789abcdef', substr(d, {}, 1)) - 1)"


@query(f"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM conversations), l AS (SELECT conv_id, turn, words, array_to_string(words, '_') AS line FROM w),
  t AS (SELECT conv_id, turn, 'w:' || unnest(words) AS token FROM l UNION ALL SELECT conv_id, turn, 'c3:' || substr(line, i, 3) FROM (SELECT conv_id, turn, line, unnest(range(1, length(line) - 1)) AS i FROM l) y),
  h AS (SELECT conv_id, turn, sha256(token) AS d FROM t),
  s AS (SELECT conv_id, turn, CAST(({_DIGIT.format(7)} * 16 + {_DIGIT.format(8)}) % 128 AS INTEGER) AS slot, CAST(sum(CASE WHEN {_DIGIT.format(10)} % 2 = 1 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM h GROUP BY ALL)
  SELECT conv_id, turn, slot, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY conv_id, turn)), 1), 6) + 0.0 AS value FROM s""")
def p17_hashed_text_features(spark, sf):
    # a small file of long texts would be read by one task
    texts = B.table(spark, sf, "conversations").select("conv_id", "turn", "text").repartition("conv_id", "turn", F.xxhash64("text"))
    tokens = texts.select("conv_id", "turn", F.explode(X.feature_tokens(F.col("text"))).alias("token"))
    slot, sign = X.feature_slot(F.col("token"))
    sums = tokens.groupBy("conv_id", "turn", slot.alias("slot")).agg(F.sum(sign).alias("v"))
    norm = F.greatest(F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("conv_id", "turn"))), F.lit(1.0))
    return sums.select("conv_id", "turn", F.col("slot").cast("int").alias("slot"), (F.round(F.col("v") / norm, 6) + 0.0).alias("value"))


@query("""WITH x AS (SELECT doc_id, sha256(text) AS d, 'opaque_part_' || lpad(CAST(doc_id % 2000 AS VARCHAR), CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 2 END, '0') AS part FROM documents)
  SELECT doc_id, regexp_matches(CASE WHEN doc_id % 5 = 0 THEN upper(d) ELSE d END, '^[0-9a-f]{64}$') AS sha, regexp_matches(part, '^opaque_part_[0-9]{3,}$') AS part FROM x""")
def p25_id_shapes(spark, sf):
    digest = F.sha2("text", 256)
    part = F.concat(F.lit("opaque_part_"), F.when(F.col("doc_id") % 3 == 0, F.lpad((F.col("doc_id") % 2000).cast("string"), 4, "0")).otherwise(F.lpad((F.col("doc_id") % 2000).cast("string"), 2, "0")))
    return B.table(spark, sf, "documents").select("doc_id", X.is_sha256(F.when(F.col("doc_id") % 5 == 0, F.upper(digest)).otherwise(digest)).alias("sha"), part.rlike("^opaque_part_[0-9]{3,}$").alias("part"))


@query("""SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'plane' WHEN 1 THEN 'cylinder' WHEN 2 THEN 'cone' WHEN 3 THEN 'sphere' WHEN 4 THEN 'torus' WHEN 5 THEN 'spline' WHEN 6 THEN 'spline' ELSE 'other' END AS bucket FROM part""")
def p26_surface_bucket(spark, sf):
    names = F.array(*map(F.lit, ["Plane", " CYLINDER", "cone x", "Sphere", "torus", "BSplineSurface", "Bezier", "thing"]))
    return B.table(spark, sf, "part").select("p_partkey", X.surface_bucket(F.element_at(names, F.col("p_size") % 8 + 1)).alias("bucket"))


@query("""SELECT p_partkey, coalesce(nullif(trim(regexp_replace(CASE WHEN p_partkey % 9 = 0 THEN '## é' ELSE '.' || p_name || ' (' || p_brand || ')' END, '[^A-Za-z0-9_.-]+', '_', 'g'), '_.-'), ''), 'assembly') AS name FROM part""")
def p27_safe_name(spark, sf):
    name = F.when(F.col("p_partkey") % 9 == 0, "## é").otherwise(F.concat(F.lit("."), "p_name", F.lit(" ("), "p_brand", F.lit(")")))
    return B.table(spark, sf, "part").select("p_partkey", X.safe_name(name).alias("name"))


@query("""SELECT event_id, CASE WHEN event_id % 10 > 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 10 > 3 AS accepted FROM events""")
def s03_read_strict_json(spark, sf):
    kind = F.col("event_id") % 10
    raw = F.when(kind == 0, '{"k": 1, "k": 2}').when(kind == 1, '{"k": NaN}').when(kind == 2, "[1]").when(kind == 3, "").otherwise(F.col("props"))
    value = X.strict_object(raw)
    return B.table(spark, sf, "events").select("event_id", F.try_variant_get(value, "$.k", "bigint").alias("k"), value.isNotNull().alias("accepted"))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN page_id % 13 = 0 THEN 'path' WHEN page_id % 10 = 0 THEN 'hash' ELSE 'ok' END AS status FROM pages) x GROUP BY 1""")
def s04_verify_file_hash(spark, sf):
    path = F.concat(F.when(F.col("page_id") % 13 == 0, "../").otherwise(""), F.col("url"))
    declared = F.when(F.col("page_id") % 10 == 0, F.sha2(F.concat("html", F.lit("x")), 256)).otherwise(F.sha2("html", 256))
    files = B.table(spark, sf, "pages").select(path.alias("path"), F.col("html").cast("binary").alias("content"), declared.alias("declared"))
    return S.verified(files).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS sha, min(source || '/' || doc_id) AS path, count(*) AS n FROM documents GROUP BY 1")
def s05_distinct_files(spark, sf):
    files = B.table(spark, sf, "documents").select(F.sha2("text", 256).alias("sha"), F.concat_ws("/", "source", "doc_id").alias("path"))
    return S.distinct_files(files)


@query("""WITH c AS (SELECT count(DISTINCT sha256(text)) AS candidates FROM documents), d AS (SELECT count(DISTINCT sha256(text)) AS entries FROM documents WHERE doc_id % 3 = 0), e AS (SELECT count(*) AS excluded FROM (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0 EXCEPT SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) x)
  SELECT candidates, entries, excluded, candidates - entries - excluded AS left_over, candidates = entries + excluded AS complete FROM c, d, e""")
def s07_cache_accounting(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return S.accounting(docs.select("sha"), docs.where("doc_id % 3 = 0").select("sha"), docs.where("doc_id % 5 = 0").select("sha"))


_ITEMS = f"""i AS (SELECT conv_id, turn, '=' || conv_id || '|=' || turn || '|' || coalesce('=' || text, '~') AS text, contains(text, '.') IS NOT TRUE AS failed, row_number() OVER (ORDER BY conv_id, turn) - 1 AS item FROM conversations),
  p AS (SELECT 0 AS k, sha256(text) AS t, item AS pos FROM i), {Q.tree_hashes('p', 'k', 64)}"""


def _items(spark, sf):
    """Turns of conversations as items; one without the end of a sentence fails."""
    return B.table(spark, sf, "conversations").select("conv_id", "turn", "text", (~F.coalesce(F.contains("text", F.lit(".")), F.lit(False))).alias("failed"))


@query(f"""WITH {_ITEMS} SELECT item // 64 AS batch, count(*) AS items, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE failed) = 0 AS complete, CASE WHEN item // 64 % 3 = 0 THEN 'resumed' ELSE 'run' END AS source, max(hash) AS input_sha256 FROM i, tree GROUP BY item // 64""")
def s10_batch_progress(spark, sf):
    """All turns in batches of 64; an earlier run has finished every third, and one bound to other items every third after these, which does not count."""
    items = _items(spark, sf)
    order = ["conv_id", "turn"]
    bound = written(item_binding(items, order, fan=64), "binding")
    batches = written(batch_progress(items, order, 64), "batches").select("batch")
    mine, other = bound.select("input_sha256", "items", F.lit(64).alias("size")), bound.select(F.sha2("input_sha256", 256).alias("input_sha256"), "items", F.lit(64).alias("size"))
    # the binding is one row
    snapshot = batches.where("batch % 3 = 0").crossJoin(F.broadcast(mine)).unionByName(batches.where("batch % 3 = 1").crossJoin(F.broadcast(other)))
    return batch_progress(items, order, 64, snapshot, fan=64).crossJoin(F.broadcast(bound.select("input_sha256")))


@query(f"""WITH {Q.CAND}, r AS (SELECT DISTINCT query, role FROM cand), s AS (SELECT query, role FROM r WHERE query % 7 <> 0 UNION SELECT query, role || 'x' FROM r WHERE query % 11 = 0)
  SELECT 'missing' AS side, query, role FROM (SELECT * FROM r EXCEPT SELECT * FROM s) a UNION ALL SELECT 'extra', query, role FROM (SELECT * FROM s EXCEPT SELECT * FROM r) b""")
def t01_domain_equal(spark, sf):
    keys = B.candidates(spark, sf).select("query", "role").distinct()
    other = keys.where("query % 7 <> 0").unionByName(keys.where("query % 11 = 0").withColumn("role", F.concat("role", F.lit("x"))))
    return S.domain_differences(keys, other)


@query("SELECT count(*) AS overlap FROM (SELECT sha256(text) FROM documents INTERSECT SELECT sha256(text) FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents WHERE doc_id % 100 = 0) b) x")
def t02_historical_overlap(spark, sf):
    docs = B.table(spark, sf, "documents")
    old = B.table(spark, sf, "benchmark").select("text").unionByName(docs.where("doc_id % 100 = 0").select("text"))
    return docs.select(F.sha2("text", 256)).intersect(old.select(F.sha2("text", 256))).agg(F.count("*").alias("overlap"))


@query("""WITH s AS (SELECT DISTINCT CASE WHEN source < 'src13' THEN 'train' ELSE 'dev' END AS split, sha256(text) AS component FROM documents), c AS (SELECT component FROM s WHERE split = 'train' INTERSECT SELECT component FROM s WHERE split = 'dev')
  SELECT count(*) AS components, count(*) = 0 AS clean FROM c""")
def t03_split_leakage_audit(spark, sf):
    rows = B.table(spark, sf, "documents").select(F.when(F.col("source") < "src13", "train").otherwise("dev").alias("split"), F.sha2("text", 256).alias("component"))
    return S.leakage(rows, "component").select(F.col("shared").alias("components"), "clean")


@query(f"""WITH {Q.CAND}, a AS (SELECT query, least(role_a, role_b) AS lo, greatest(role_a, role_b) AS hi FROM edge), b AS (SELECT query, lo, CASE WHEN query % 4 = 0 THEN hi || '!' ELSE hi END AS hi FROM a WHERE query % 9 <> 0),
  j AS (SELECT coalesce(a.query, b.query) AS query, a.lo AS l, b.lo AS r FROM a FULL OUTER JOIN b ON a.query = b.query AND a.lo = b.lo AND a.hi = b.hi)
  SELECT query, count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS shared, count(*) FILTER (WHERE r IS NULL) AS missing, count(*) FILTER (WHERE l IS NULL) AS extra FROM j GROUP BY query""")
def t04_edge_set_match(spark, sf):
    want = B.edges(spark, sf).select("query", F.least("role_a", "role_b").alias("lo"), F.greatest("role_a", "role_b").alias("hi"))
    got = want.where("query % 9 <> 0").withColumn("hi", F.when(F.col("query") % 4 == 0, F.concat("hi", F.lit("!"))).otherwise(F.col("hi")))
    return S.edge_match(want, got)


@query("SELECT 'missing' AS side, doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) x UNION ALL SELECT 'extra', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents) y")
def t05_mapped_case_set(spark, sf):
    return S.domain_differences(B.table(spark, sf, "documents").select("doc_id"), B.table(spark, sf, "labels").select("doc_id"))


_ROW = "sha256(array_to_string(['=' || doc_id, '=' || lang, '=' || source, '=' || n_chars], chr(31)))"


@query(f"SELECT doc_id, {_ROW} AS hash FROM documents")
def v01_row_hash(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", X.row_hash(*map(F.col, ["doc_id", "lang", "source", "n_chars"])).alias("hash"))


@query("SELECT doc_id % 17 <> 0 AS intact, count(*) AS n FROM documents GROUP BY 1")
def v02_self_hash_check(spark, sf):
    fields = [*map(F.col, ["doc_id", "lang", "source"])]
    stored = B.table(spark, sf, "documents").withColumn("hash", F.when(F.col("doc_id") % 17 == 0, X.row_hash(F.lit("other"))).otherwise(X.row_hash(*fields)))
    return stored.groupBy((F.col("hash") == X.row_hash(*fields)).alias("intact")).agg(F.count("*").alias("n"))


@query(f"""WITH f AS (SELECT page_id % 3 AS bundle, url || ':' || sha256(html) AS t, row_number() OVER (PARTITION BY page_id % 3 ORDER BY url, sha256(html)) - 1 AS pos FROM pages), {Q.tree_hashes('f', 'bundle', 64)}
  SELECT bundle, n AS files, hash FROM tree""")
def v03_bundle_hash(spark, sf):
    """Three bundles of all pages, in the order of url and file hash."""
    files = B.table(spark, sf, "pages").select((F.col("page_id") % 3).alias("bundle"), "url", F.sha2("html", 256).alias("sha"))
    return ordered_hashes(files, ["bundle"], ["url", "sha"], F.concat("url", F.lit(":"), "sha"), fan=64).withColumnRenamed("n", "files")


@query("SELECT doc_id, sha256('case' || chr(0) || source || chr(0) || doc_id) AS token FROM documents")
def v04_case_token(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", X.case_token(F.lit("case"), F.col("source"), F.col("doc_id").cast("string")).alias("token"))


@query("""SELECT source, count(*) AS rows, count(DISTINCT doc_id) AS ids, min(lang) AS first_lang, CASE WHEN count(*) <> count(DISTINCT doc_id) THEN 'duplicate_id' WHEN count(*) < 30 THEN 'count' ELSE 'ok' END AS status FROM documents GROUP BY source""")
def v05_family_split_check(spark, sf):
    out = B.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids"), F.min("lang").alias("first_lang"))
    return out.withColumn("status", F.when(F.col("rows") != F.col("ids"), "duplicate_id").when(F.col("rows") < 30, "count").otherwise("ok"))


@query("""SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'case' WHEN d.source = 'src3' THEN 'split' WHEN l.quality NOT IN (0, 1) THEN 'label' WHEN l.quality = 0 AND l.toxic = 1 THEN 'consistency' ELSE 'ok' END AS status FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""")
def v06_training_row_check(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", "source").withColumn("has", F.lit(True))
    status = (
        F.when(F.col("has").isNull(), "case").when(F.col("source") == "src3", "split").when(~F.col("quality").isin(0, 1), "label")
        .when((F.col("quality") == 0) & (F.col("toxic") == 1), "consistency").otherwise("ok")
    )
    return B.table(spark, sf, "labels").join(docs, "doc_id", "left").select("doc_id", status.alias("status"))


_DESCRIPTOR = "lower(trim(l_returnflag)) || '|' || lower(trim(l_linestatus)) || '|' || lower(trim(o_orderstatus)) || '|' || lower(trim(o_orderpriority))"


@query(f"""WITH d AS (SELECT {_DESCRIPTOR} AS descriptor, o_orderkey % 6 > 0 AS train FROM lineitem JOIN orders ON l_orderkey = o_orderkey), u AS (SELECT DISTINCT sha256(descriptor) AS hash, descriptor FROM d WHERE train)
  SELECT CAST(row_number() OVER (ORDER BY hash) - 1 AS INTEGER) AS idx, substr(hash, 1, 16) AS id, descriptor FROM u""")
def v09_program_catalog(spark, sf):
    return S.catalog(_descriptors(spark, sf).where("train"))


def _descriptors(spark, sf):
    fields = ["l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority"]
    joined = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", F.concat_ws("|", *[F.lower(F.trim(c)) for c in fields]).alias("descriptor"), (F.col("o_orderkey") % 6 > 0).alias("train"))


@query(f"""WITH d AS (SELECT {_DESCRIPTOR} AS descriptor, o_orderkey % 6 > 0 AS train FROM lineitem JOIN orders ON l_orderkey = o_orderkey), u AS (SELECT DISTINCT sha256(descriptor) AS hash, descriptor FROM d WHERE train AND descriptor NOT LIKE '%urgent%'),
  c AS (SELECT descriptor, CAST(row_number() OVER (ORDER BY hash) - 1 AS INTEGER) AS idx FROM u)
  SELECT c.idx, CASE WHEN c.idx IS NULL THEN 'out_of_vocabulary' ELSE 'found' END AS status, count(*) AS n FROM d LEFT JOIN c USING (descriptor) WHERE NOT train GROUP BY ALL""")
def j32_catalog_lookup(spark, sf):
    rows = _descriptors(spark, sf)
    known = S.catalog(rows.where("train and descriptor not like '%urgent%'"))
    return S.looked_up(rows.where("not train"), known).groupBy("idx", "status").agg(F.count("*").alias("n"))


@query("""SELECT d.source, count(*) AS rows, count(DISTINCT l.doc_id) AS cases, count(*) FILTER (WHERE l.quality = 1) AS positive, count(*) FILTER (WHERE l.quality = 0) AS negative, array_to_string(list_sort(list(DISTINCT d.lang)), ',') AS langs
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.source""")
def g16_dataset_manifest(spark, sf):
    joined = B.table(spark, sf, "labels").join(B.table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    return joined.groupBy("source").agg(
        F.count("*").alias("rows"), F.count_distinct("doc_id").alias("cases"), F.count_if(F.col("quality") == 1).alias("positive"),
        F.count_if(F.col("quality") == 0).alias("negative"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs"),
    )


@query(f"""WITH h AS (SELECT {_ROW} AS hash FROM documents), b AS (SELECT substr(hash, 1, 4) AS bucket, sha256(string_agg(hash, '' ORDER BY hash)) AS part FROM h GROUP BY 1)
  SELECT sha256(string_agg(part, '' ORDER BY bucket)) AS fingerprint, count(*) AS buckets FROM b""")
def d03_table_fingerprint(spark, sf):
    return S.fingerprint(B.table(spark, sf, "documents").select(X.row_hash(*map(F.col, ["doc_id", "lang", "source", "n_chars"])).alias("hash")))
