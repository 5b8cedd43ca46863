"""Records that are hashed, chained and checked: face bindings, prediction ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.sources.tables import written

from .ordering import ordered_hashes, positions


def face_bindings(faces: DataFrame, namespace: str, gauge: str, fan: int = 1024) -> DataFrame:
    """part, faces, hash of faces (part, face, signature): SHA-256 over name space, gauge, the number of distinct faces and the ordered tree of
    `face:signature`.  Faces below 0 or null, and faces without a signature, do not bind; of a face given twice the least signature counts."""
    valid = faces.where("face >= 0 and signature is not null").groupBy("part", "face").agg(F.min("signature").alias("signature"))
    tree = ordered_hashes(valid, ["part"], ["face", "signature"], F.concat_ws(":", "face", "signature"), fan)
    return tree.select("part", F.col("n").alias("faces"), F.sha2(F.concat_ws("\x00", F.lit(namespace), F.lit(gauge), "n", "hash"), 256).alias("hash"))


def _text(*fields) -> Column:
    """Fields of one row in a canonical text; null and empty differ."""
    return F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), f.cast("string")), F.lit("~")) for f in fields])


def _lines(rows) -> Column:
    return F.array_join(F.transform(rows, lambda x: x["text"]), ";")


def prediction_ledger(queries: DataFrame, hypotheses: DataFrame, programs: DataFrame, alternatives: DataFrame) -> DataFrame:
    """query, status, hypotheses, row_text, row_sha256: one nested row of each query, with its hash.

    queries (query), hypotheses (query, rank, score, identity), programs (query, rank, edge, mobility), alternatives (query, rank, edge, place, a, b).  hypotheses: array of rank, score, identity,
    programs, which have edge, mobility and alternatives, which have place, a, b; each level in its order.  A query without hypotheses is no_candidate.  A query's
    ledger is a bounded group, by the beam, its edges and the alternatives kept.
    """
    leaf = alternatives.withColumn("text", _text(*map(F.col, ["place", "a", "b"])))
    kept = leaf.groupBy("query", "rank", "edge").agg(F.array_sort(F.collect_list(F.struct("place", "a", "b", "text"))).alias("alternatives"))
    edges = programs.join(kept, ["query", "rank", "edge"], "left")
    none = F.array().cast(dict(kept.dtypes)["alternatives"])
    edges = edges.withColumn("alternatives", F.coalesce("alternatives", none))
    edges = edges.withColumn("text", F.concat(_text(F.col("edge"), F.col("mobility")), F.lit("("), _lines("alternatives"), F.lit(")")))
    by_rank = edges.groupBy("query", "rank").agg(F.array_sort(F.collect_list(F.struct("edge", "mobility", "alternatives", "text"))).alias("programs"))
    found = hypotheses.join(by_rank, ["query", "rank"], "left")
    found = found.withColumn("programs", F.coalesce("programs", F.array().cast(dict(by_rank.dtypes)["programs"])))
    found = found.withColumn("text", F.concat(_text(F.col("rank"), F.col("score"), F.col("identity")), F.lit("["), _lines("programs"), F.lit("]")))
    rows = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "identity", "programs", "text"))).alias("hypotheses"))
    every = queries.select("query").distinct().join(rows, "query", "left").withColumn("hypotheses", F.coalesce("hypotheses", F.array().cast(dict(rows.dtypes)["hypotheses"])))
    status = F.when(F.size("hypotheses") > 0, "prediction_ready").otherwise("no_candidate")
    text = F.concat_ws("\n", _text(F.col("query"), F.col("status")), _lines("hypotheses"))
    return every.withColumn("status", status).withColumn("row_text", text).withColumn("row_sha256", F.sha2("row_text", 256)).select("query", "status", "hypotheses", "row_text", "row_sha256")


def ledger_payload(ledger: DataFrame, header: dict[str, str], fan: int = 1024) -> DataFrame:
    """One row: queries and payload_sha256, over the header's entries by name and the ordered tree of `query:row hash`; an empty ledger has the header's alone."""
    tree = ordered_hashes(ledger.select("query", "row_sha256"), [], ["query", "row_sha256"], F.concat_ws(":", "query", "row_sha256"), fan)
    head = F.lit("\n".join(f"{k}={header[k]}" for k in sorted(header)))
    whole = tree.agg(F.coalesce(F.max("n"), F.lit(0)).alias("queries"), F.coalesce(F.max("hash"), F.lit("")).alias("hash"))
    return whole.select("queries", F.sha2(F.concat_ws("\n", head, "queries", "hash"), 256).alias("payload_sha256"))


def ledger_faults(ledger: DataFrame) -> DataFrame:
    """query, fault of the rows whose hash, text or status does not follow from what they nest: text (the nested rows say otherwise), hash, or status."""
    alternative = lambda x: F.struct(x["place"], x["a"], x["b"], _text(x["place"], x["a"], x["b"]).alias("text"))
    edge = lambda e: F.concat(_text(e["edge"], e["mobility"]), F.lit("("), _lines(F.transform(e["alternatives"], alternative)), F.lit(")"))
    one = lambda h: F.concat(_text(h["rank"], h["score"], h["identity"]), F.lit("["), F.array_join(F.transform(h["programs"], edge), ";"), F.lit("]"))
    again = F.concat_ws("\n", _text(F.col("query"), F.col("status")), F.array_join(F.transform("hypotheses", one), ";"))
    status = F.when(F.size("hypotheses") > 0, "prediction_ready").otherwise("no_candidate")
    fault = F.when(F.col("status") != status, "status").when(F.col("row_text") != again, "text").when(F.col("row_sha256") != F.sha2(again, 256), "hash")
    return ledger.select("query", fault.alias("fault")).where("fault is not null")


def batch_progress(items: DataFrame, order: list[str], size: int, snapshot: DataFrame | None = None, fan: int = 1024) -> DataFrame:
    """batch, items, failed, complete, source: the batches of `size` items in order, and which of them an earlier run has done.

    items: the order columns, text, and failed (a boolean; null counts as failed).  snapshot (input_sha256, items, size, batch): one row of each batch that a run has finished, with what the run was bound to.  Only rows that
    were bound to these items, their number and this size count (source: resumed); rows bound to anything else are refused, and their batches run again.
    """
    placed = positions(items, [], order, "item")
    bound = item_binding(items, order, fan)
    batches = placed.groupBy(F.floor(F.col("item") / size).alias("batch")).agg(F.count("*").alias("items"), F.count_if(F.coalesce(F.col("failed"), F.lit(True))).alias("failed"))
    found = batches.withColumn("complete", F.col("failed") == 0)
    if snapshot is None:
        return found.withColumn("source", F.lit("run"))
    # one row of binding
    same = snapshot.join(F.broadcast(bound.select(F.col("input_sha256"), F.col("items"))), ["input_sha256", "items"]).where(F.col("size") == size)
    done = same.select("batch", F.lit("resumed").alias("source")).distinct()
    return found.join(done, "batch", "left").withColumn("source", F.coalesce("source", F.lit("run")))


def item_binding(items: DataFrame, order: list[str], fan: int = 1024) -> DataFrame:
    """One row: items, input_sha256 of all items' order columns and text, in order."""
    tree = ordered_hashes(items.select(*order, "text"), [], order, F.sha2(_text(*map(F.col, order), F.col("text")), 256), fan)
    return tree.agg(F.coalesce(F.max("n"), F.lit(0)).alias("items"), F.coalesce(F.max("hash"), F.lit("")).alias("input_sha256"))


def example_reasons(candidates: DataFrame, targets: DataFrame, types: list[str], most: int = 512) -> DataFrame:
    """example, reason: valid, or the first rule that an example's programs or target break.

    candidates (example, idx, id, type, descriptor, relation: the descriptor's type), targets (example, idx, translation, rotation).  In turn: too_few (under two programs), too_many, index (null, negative or twice), type
    (outside the list, or other than the descriptor's), id (not catalog_ and the first 16 hex digits of the descriptor's SHA-256), twin (an id or descriptor twice), target (an index that no program has),
    translation (not three finite numbers), rotation (not nine finite ones, orthonormal and of determinant 1).  Examples without a target are `target`.
    """
    right = F.concat(F.lit("catalog_"), F.substring(F.sha2("descriptor", 256), 1, 16))
    flags = candidates.groupBy("example").agg(
        F.count("*").alias("n"), F.bool_or(F.col("idx").isNull() | (F.col("idx") < 0)).alias("bad_index"), F.count_distinct("idx").alias("indices"),
        F.bool_or(~F.coalesce(F.col("type").isin(types) & (F.col("type") == F.col("relation")), F.lit(False))).alias("bad_type"), F.bool_or(~F.coalesce(F.col("id") == right, F.lit(False))).alias("bad_id"),
        F.count_distinct("id").alias("ids"), F.count_distinct("descriptor").alias("descriptors"),
    )
    known = candidates.select("example", "idx").distinct().withColumn("known", F.lit(True))
    goal = targets.join(known, ["example", "idx"], "left")
    every = candidates.select("example").unionByName(targets.select("example")).distinct().join(flags, "example", "left").join(goal, "example", "left")
    fine = lambda c, size: F.coalesce((F.size(c) == size) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    r = [F.try_element_at("rotation", F.lit(i + 1)) for i in range(9)]
    inner = lambda i, j: r[3 * i] * r[3 * j] + r[3 * i + 1] * r[3 * j + 1] + r[3 * i + 2] * r[3 * j + 2]
    bent = F.lit(False)
    for i in range(3):
        for j in range(i, 3):
            bent = bent | (F.abs(inner(i, j) - (1.0 if i == j else 0.0)) > 1e-6)
    det = r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])
    n = F.coalesce("n", F.lit(0))
    reason = (
        F.when(n < 2, "too_few").when(n > most, "too_many").when(F.col("bad_index") | (F.col("indices") < n), "index").when(F.col("bad_type"), "type").when(F.col("bad_id"), "id")
        .when((F.col("ids") < n) | (F.col("descriptors") < n), "twin").when(F.col("known").isNull(), "target").when(~fine("translation", 3), "translation")
        .when(~fine("rotation", 9) | bent | (F.abs(det - 1.0) > 1e-6), "rotation").otherwise("valid")
    )
    return every.select("example", reason.alias("reason"))


def semantic_commitments(rows: DataFrame, committed: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(case, split, rows, missing, extra, differing, verified; split, cases, rows: totals of verified cases).

    rows (case, place, id, sha) are what a library holds, committed (case, place, id, sha) what was committed to, place by place, cases (case, split, row_count: as declared).  missing: rows without a commitment, extra: the other way round,
    differing: another hash or id at one place.  A case is verified if all three are 0 and it has as many rows as declared.
    """
    left = rows.select("case", "place", "id", "sha")
    right = committed.select("case", "place", F.col("id").alias("c_id"), F.col("sha").alias("c_sha"))
    both = left.join(right, ["case", "place"], "full_outer")
    off = F.col("sha").isNotNull() & F.col("c_sha").isNotNull() & ((F.col("sha") != F.col("c_sha")) | ~F.col("id").eqNullSafe(F.col("c_id")))
    each = both.groupBy("case").agg(F.count("sha").alias("rows"), F.count_if(F.col("c_sha").isNull()).alias("missing"), F.count_if(F.col("sha").isNull()).alias("extra"), F.count_if(off).alias("differing"))
    out = cases.join(each, "case", "left").select("case", "split", "row_count", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "missing", "extra", "differing")])
    out = out.withColumn("verified", (F.col("missing") + F.col("extra") + F.col("differing") == 0) & (F.col("rows") == F.col("row_count"))).drop("row_count")
    return out, out.where("verified").groupBy("split").agg(F.count("*").alias("cases"), F.sum("rows").alias("rows"))


def catalog_candidates(examples: DataFrame, catalog: DataFrame, most: int = 512) -> DataFrame:
    """Every example with every entry of the catalog; a catalog of more than `most` entries is refused."""
    if catalog.limit(most + 1).count() > most:
        raise ValueError(f"a catalog has {most} entries at most")
    return examples.crossJoin(F.broadcast(catalog))


def authority_projection(rows: DataFrame, assigned: DataFrame, digest: Column, splits: list[str]) -> tuple[DataFrame, DataFrame]:
    """(split, slot, case, ordinal, hash; split, rows, sha256) of the rows (case, ordinal and what the digest reads) assigned (case, split) to one of the splits: no other row comes out.

    Slots count from 0 in the order of case and ordinal within a split.  The receipt has the ordered tree of a split's `slot:hash` lines.
    """
    own = rows.join(assigned.where(F.col("split").isin(splits)).select("case", "split"), "case").select("split", "case", "ordinal", digest.alias("hash"))
    placed = positions(own, ["split"], ["case", "ordinal", "hash"], "slot")
    tree = ordered_hashes(placed.select("split", "slot", "hash"), ["split"], ["slot"], F.concat_ws(":", "slot", "hash"))
    return placed.select("split", "slot", "case", "ordinal", "hash"), tree.select("split", F.col("n").alias("rows"), F.col("hash").alias("sha256"))


def projection_faults(projection: DataFrame, receipts: DataFrame, splits: list[str]) -> DataFrame:
    """split, fault of a projection that is read back: held_out (a split that must not be there), gap (slots that do not count from 0), twice (a case and ordinal again), receipt (other rows or hashes)."""
    each = projection.groupBy("split").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count_distinct("slot").alias("slots"), F.count_distinct("case", "ordinal").alias("rows"))
    tree = ordered_hashes(projection.select("split", "slot", "hash"), ["split"], ["slot"], F.concat_ws(":", "slot", "hash")).select("split", "hash")
    both = each.join(tree, "split").join(receipts.select("split", F.col("rows").alias("said"), "sha256"), "split", "full_outer")
    gap = (F.col("low") != 0) | (F.col("high") != F.col("n") - 1) | (F.col("slots") != F.col("n"))
    fault = (
        F.when(~F.col("split").isin(splits), "held_out").when(gap, "gap").when(F.col("rows") < F.col("n"), "twice")
        .when(~(F.col("n").eqNullSafe(F.col("said")) & F.col("hash").eqNullSafe(F.col("sha256"))), "receipt")
    )
    return both.select("split", fault.alias("fault")).where("fault is not null")


def model_view_payload(graphs: DataFrame, examples: DataFrame, programs: DataFrame, targets: DataFrame, types: list[str], most: int = 512, fan: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(example, reason, text; one row: graphs, examples, refused, sha256) of what a model may see: graph views and examples, with nothing of where they come from.

    graphs (graph, view: a hash of its canonical nodes and edges), examples (example, graph_a, graph_b), programs and targets as example_reasons takes them.  An example's text has its
    two views, its programs in the order of their index, and its target's index, translation and rotation, to twelve digits.  An example that breaks a rule, or names a graph that is not there (graph), is
    refused and has no text.  The payload's hash is over the ordered trees of `graph:view` and of the texts, so it does not depend on the order in which anything is given.
    """
    # both ends meet the views in one join, and what follows reads the finished rows
    ends = examples.select("example", F.explode(F.array(*[F.struct(F.lit(x).alias("side"), F.col(f"graph_{x}").alias("graph")) for x in "ab"])).alias("end")).select("example", "end.*")
    seen = ends.join(graphs.select("graph", "view"), "graph", "left").groupBy("example").agg(*[F.max(F.when(F.col("side") == x, F.col("view"))).alias(f"view_{x}") for x in "ab"])
    listed = programs.groupBy("example").agg(F.array_sort(F.collect_list(F.struct("idx", "id", "type", "descriptor"))).alias("p"))
    number = lambda x: F.format_number(F.round(x, 12) + 0.0, 12)
    numbers = lambda c: F.array_join(F.transform(c, number), ",")
    goal = targets.select("example", F.concat_ws("|", "idx", numbers("translation"), numbers("rotation")).alias("goal"))
    rows = seen.join(example_reasons(programs, targets, types, most), "example", "left").join(listed, "example", "left").join(goal, "example", "left")
    gone = F.col("view_a").isNull() | F.col("view_b").isNull()
    reason = F.when(F.coalesce("reason", F.lit("too_few")) != "valid", F.coalesce("reason", F.lit("too_few"))).when(gone, "graph").otherwise("valid")
    body = F.array_join(F.transform("p", lambda p: F.concat_ws(":", p["idx"], p["id"], p["type"], p["descriptor"])), ";")
    rows = rows.withColumn("reason", reason).withColumn("text", F.when(F.col("reason") == "valid", F.concat_ws("/", "view_a", "view_b", body, "goal")))
    rows = written(rows.select("example", "reason", "text"), "payload-rows")
    count = lambda df: df.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("hash"), F.lit("")).alias("h"))
    g = count(ordered_hashes(graphs, [], ["graph"], F.concat_ws(":", "graph", "view"), fan)).select(F.col("n").alias("graphs"), F.col("h").alias("g"))
    e = count(ordered_hashes(rows.where("text is not null"), [], ["example"], F.col("text"), fan)).select(F.col("n").alias("examples"), F.col("h").alias("e"))
    refused = rows.agg(F.count_if(F.col("text").isNull()).alias("refused"))
    # one row beside one row
    return rows, g.crossJoin(e).crossJoin(refused).select("graphs", "examples", "refused", F.sha2(F.concat_ws("\n", "graphs", "g", "examples", "e"), 256).alias("sha256"))
