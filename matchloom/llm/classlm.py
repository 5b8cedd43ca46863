"""Language-model scores from Brown class-based bigrams.

A text's probability is the product of P(class | class before) and P(word | class) over its words and its end,
both smoothed by adding one.  Every word has a class, by exchange clustering:

* the `heads` commonest words, and `tails` units that hold all other words by their last two
  bytes, are exchanged one by one between classes as long as that raises the likelihood of the class bigrams;
* then every other word that stands `least` times or more leaves its unit, by predictive exchange: in each round all such words go at once to the class under
  which what stands before them is likeliest, and the class counts are made anew, until a round
  gains no more.  Such a round never lowers the likelihood but for the smoothing.  What stands before a word is named by its unit's group, of
  NEAR at most, so a word has one short row of counts that all rounds read;
* words that stand less often stay in their unit, and so do unseen ones.

So the clustered words grow with the corpus, and the number of classes with the cube root of its vocabulary.

All counts are taken over all training documents.  Words meet their counts and classes by
chunks: a task names the distinct words of each chunk of texts once, those names are
joined to the words' table, and the chunk's texts are summed where the answers arrive.  So no
vocabulary is broadcast or gathered, and nothing is moved once per word of text but its place in the chunk's list.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, ids_and_texts, literal_array, partitions, recorded, schema, written
from .text import Words, lists, mix, slices

END = np.uint64(0x5851F42D4C957F2D)
CHUNK_WORDS = 1_000_000
NEAR = 48
_MERGE_AT = 1_000_000


def _tokens(batch: pa.RecordBatch, tails: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names of all words and ends, their tail units, places where texts begin, one more than texts)."""
    words = Words(batch.column("text"), lower=True)
    last = words.data[words.ends - 1].astype(np.int64) | 32
    other = np.where(words.ends - words.starts > 1, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.int64) | 32
    tail = (last * 31 + other) % tails
    stops = words.first[1:]
    first = words.first + np.arange(len(words.first))
    return np.insert(words.names, stops, END), np.insert(tail, stops, 0), first


def _merged(names: list[np.ndarray], others: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list, list, list]:
    every, first, place = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
    total = np.bincount(place, np.concatenate(counts), minlength=len(every)).astype(np.int64)
    return [every], [np.concatenate(others)[first]], [total]


def _counted(batches: Iterator[pa.RecordBatch], tails: int) -> Iterator[pa.RecordBatch]:
    held: tuple[list, list, list] = ([], [], [])

    def rows() -> pa.RecordBatch:
        columns = [pa.array(held[0][0].view(np.int64)), pa.array(held[1][0], pa.int32()), pa.array(held[2][0])]
        return pa.RecordBatch.from_arrays(columns, names=["name", "tail", "n"])

    size = 0
    for batch in slices(batches, "text"):
        names, tail, _ = _tokens(batch, tails)
        every, first, n = np.unique(names, return_index=True, return_counts=True)
        for part, x in zip(held, (every, tail[first], n), strict=True):
            part.append(x)
        size += len(every)
        if size > _MERGE_AT:
            held = _merged(*held)
            size = len(held[0][0])
            if size > _MERGE_AT // 2:
                yield rows()
                held, size = ([], [], []), 0
    if size:
        held = _merged(*held)
        yield rows()


def _units(names: np.ndarray, tail: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """heads: the sorted names with a unit of their own."""
    at = np.minimum(np.searchsorted(heads, names), max(0, len(heads) - 1))
    return np.where(heads[at] == names, at, len(heads) + tail) if len(heads) else tail


def _pairs(batches: Iterator[pa.RecordBatch], heads: np.ndarray, tails: int) -> Iterator[pa.RecordBatch]:
    n = len(heads) + tails
    total = np.zeros(n * n, np.int64)
    end = int(_units(np.array([END]), np.zeros(1, np.int64), heads)[0])
    for batch in slices(batches, "text"):
        names, tail, first = _tokens(batch, tails)
        unit = _units(names, tail, heads)
        before = np.concatenate([[end], unit[:-1]]) if len(unit) else unit
        total += np.bincount(before * n + unit, minlength=n * n)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["pair", "n"])


def _contexts(batches: Iterator[pa.RecordBatch], heads: np.ndarray, tails: int, near: np.ndarray) -> Iterator[pa.RecordBatch]:
    """name, code, n of words that are no heads: code is the group (near, by unit) of the word before."""
    end = near[_units(np.array([END]), np.zeros(1, np.int64), heads)[0]]
    held: list[list[np.ndarray]] = [[], [], []]
    size = 0

    def merged() -> list[list[np.ndarray]]:
        names, codes, counts = (np.concatenate(x) for x in held)
        _, first, place = np.unique(names + mix(codes.astype(np.uint64) + np.uint64(1)), return_index=True, return_inverse=True)
        return [[names[first]], [codes[first]], [np.bincount(place, counts).astype(np.int32)]]

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[1][0], pa.int32()), pa.array(held[2][0], pa.int64())], names=["name", "code", "n"])

    for batch in slices(batches, "text"):
        names, tail, _ = _tokens(batch, tails)
        unit = _units(names, tail, heads)
        free = np.flatnonzero(unit >= len(heads))
        codes, own = np.concatenate([[end], near[unit[:-1]]])[free] if len(unit) else unit, names[free]
        _, first, n = np.unique(own + mix(codes.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
        for part, x in zip(held, (own[first], codes[first].astype(np.int32), n.astype(np.int32)), strict=True):
            part.append(x)
        size += len(first)
        if size > _MERGE_AT:
            held = merged()
            size = len(held[0][0])
            if size > _MERGE_AT // 2:
                yield rows()
                held, size = [[], [], []], 0
    if size:
        held = merged()
        yield rows()


def exchange_clusters(pairs: np.ndarray, classes: int, sweeps: int = 30) -> np.ndarray:
    """The class of each unit: units move one by one to the class that raises the sum over class pairs of n log n,
    less the sums over classes, until a sweep moves none or `sweeps` are done."""
    units = len(pairs)
    order = np.argsort(-pairs.sum(axis=0), kind="stable")
    cls = np.zeros(units, np.int64)
    cls[order] = np.arange(units) % classes
    # how often each unit stands before and behind each class, and the class pairs; kept up to date move by move
    to, of = pairs @ np.eye(classes)[cls], pairs.T @ np.eye(classes)[cls]
    m = np.eye(classes)[cls].T @ to
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    for _ in range(sweeps):
        moved = 0
        for u in order:
            old, own = cls[u], pairs[u, u]
            row, column = to[u].copy(), of[u].copy()
            row[old] -= own
            column[old] -= own
            m[old] -= row
            m[:, old] -= column
            m[old, old] -= own
            # what the sum gains when u joins class c: row c, column c, and the totals change
            base = f(m)
            gain = (f(m + row[None, :]) - base).sum(axis=1) + (f(m + column[:, None]) - base).sum(axis=0)
            d, left, right = np.diag(m), m.sum(axis=1), m.sum(axis=0)
            gain += f(d + row + column + own) - f(d + row) - f(d + column) + f(d)
            a, b = row.sum() + own, column.sum() + own
            before_l, before_r = f(left + column).sum() - f(left + column), f(right + row).sum() - f(right + row)
            gain -= before_l + f(left + column + a) + before_r + f(right + row + b)
            new = int(np.argmax(gain))
            if new == old or gain[new] <= gain[old] + 1e-9 * max(1.0, abs(gain[new])):
                new = old
            m[new] += row
            m[:, new] += column
            m[new, new] += own
            if new != old:
                cls[u] = new
                to[:, old] -= pairs[:, u]
                to[:, new] += pairs[:, u]
                of[:, old] -= pairs[u]
                of[:, new] += pairs[u]
                moved += 1
        if not moved:
            break
    return cls


def _likelihood(counts: np.ndarray) -> float:
    """The log likelihood of what stands before, given the classes; counts [code, class]."""
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    return float(f(counts).sum() - f(counts.sum(axis=0)).sum())


def _table(counts: np.ndarray) -> np.ndarray:
    """log P(code | class), smoothed by adding a half."""
    return np.log((counts + 0.5) / (counts + 0.5).sum(axis=0))


def _codes(batch: pa.RecordBatch, codes: int) -> np.ndarray:
    out = np.zeros((batch.num_rows, codes))
    found = batch.column("found")
    row = np.repeat(np.arange(batch.num_rows), found.value_lengths().to_numpy())
    flat = found.flatten()
    out[row, flat.field("code").to_numpy()] = flat.field("n").to_numpy()
    return out


def _chosen(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each word's likeliest class, the first of equals."""
    for batch in batches:
        best = (_codes(batch, len(table)) @ table).argmax(axis=1) if batch.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(best, pa.int32())], names=["name", "class"])


def _changed(batches: Iterator[pa.RecordBatch], table: np.ndarray, of_tail: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What the counts [code, class] change by, as one row of numbers, when the task's words leave their units for the likeliest classes."""
    total = np.zeros(table.shape)
    one = np.eye(table.shape[1])
    for batch in batches:
        if batch.num_rows:
            codes = _codes(batch, len(table))
            total += codes.T @ (one[(codes @ table).argmax(axis=1)] - one[of_tail[batch.column("tail").to_numpy()]])
    yield pa.RecordBatch.from_arrays([lists(total.ravel(), np.array([0, total.size]), pa.float64())], names=["change"])


def word_classes(vectors: DataFrame, counts: np.ndarray, of_tail: np.ndarray, rounds: int = 10, tolerance: float = 1e-5) -> DataFrame:
    """Words (name, tail, found: their codes and numbers) -> name, class, from the counts [code, class] with all of them in their tails' classes."""
    table, now, best = _table(counts), counts, _likelihood(counts)
    for _ in range(rounds):
        parts = vectors.mapInArrow(partial(_changed, table=table, of_tail=of_tail), schema("change array<double>"))
        summed = parts.select(F.posexplode("change").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("x")).toArrow().to_pandas()
        change = np.zeros(counts.size)
        change[summed["place"]] = summed["x"]
        now = np.maximum(0.0, counts + change.reshape(counts.shape))
        value = _likelihood(now)
        if value <= best + tolerance * abs(best):
            break
        table, best = _table(now), value
    return vectors.mapInArrow(partial(_chosen, table=table), schema("name long, class int"))


def _packed(places: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The places of each text, seven bits a byte, the low ones first, with the eighth bit where more follow."""
    size = 1 + sum((places >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    stop = np.cumsum(size)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    for i in range(5):
        has = size > i
        out[(stop - size)[has] + i] = (places[has] >> 7 * i) & 127 | np.where(size[has] > i + 1, 128, 0)
    raw, edge = out.tobytes(), np.concatenate([[0], stop])[first]
    return [raw[a:b] for a, b in zip(edge, edge[1:], strict=False)]


def _unpacked(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All places of the texts, and where texts begin, one more than texts."""
    data = np.frombuffer(b"".join(packed), np.uint8)
    ends = np.flatnonzero(data < 128)
    start = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    size, places = ends - start + 1, np.zeros(len(ends), np.int64)
    for i in range(int(size.max(initial=0))):
        has = size > i
        places[has] |= (data[start[has] + i] & 127).astype(np.int64) << 7 * i
    edges = np.concatenate([[0], np.cumsum([len(x) for x in packed])]).astype(np.int64)
    return places, np.searchsorted(ends, edges)


def _chunked(batches: Iterator[pa.RecordBatch], tails: int) -> Iterator[pa.RecordBatch]:
    """Rows of texts with the packed places of their words in the chunk's list, and for each chunk of texts that list: distinct names and tails.

    A slice's commonest new words come first in the list, as small places take fewer bytes.
    """
    part, chunk, held = TaskContext.get().partitionId(), 0, 0
    names_of = ["chunk", "doc_id", "words", "names", "tails"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    seen: dict[int, int] = {}
    listed: list[np.ndarray] = []

    def row(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) if not isinstance(x, pa.Array) else x for x, k in zip(columns, kinds, strict=True)], names=names_of)

    def names_row() -> pa.RecordBatch:
        names = np.fromiter(seen, np.uint64, len(seen)).view(np.int64)
        return row([[part << 32 | chunk], [None], [None], [names], [np.concatenate(listed)]])

    for batch in slices(batches, "text"):
        names, tail, first = _tokens(batch, tails)
        every, at, place, times = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
        known = len(seen)
        common = np.argsort(-times, kind="stable")
        local = np.empty(len(every), np.int64)
        local[common] = np.fromiter((seen.setdefault(x, len(seen)) for x in every[common].tolist()), np.int64, len(every))
        listed.append(tail[at[common]][local[common] >= known])
        held += len(names)
        n = batch.num_rows
        yield row([np.full(n, part << 32 | chunk), batch.column("doc_id"), _packed(local[place], first), [None] * n, [None] * n])
        if held > CHUNK_WORDS:
            yield names_row()
            chunk, held, seen, listed = chunk + 1, 0, {}, []
    if seen:
        yield names_row()


def _looked_up(texts: pd.DataFrame, words: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and classes of all words of the texts, and where texts begin, one more than texts."""
    places, first = _unpacked(texts["words"].tolist())
    n, cls = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    n[words["place"]], cls[words["place"]] = words["n"], words["class"]
    return n[places], cls[places], first


def _number(classes: int) -> np.dtype:
    """How a class is stored: a byte each up to 256 of them, two up to 65,536."""
    if classes > 1 << 16:
        raise ValueError("there may be 65,536 classes at most")
    return np.dtype("u1" if classes <= 256 else "<u2")


def _classed(texts: pd.DataFrame, words: pd.DataFrame, kind: np.dtype) -> pd.DataFrame:
    """The chunk's texts with the classes of their words, in the bytes of `kind`."""
    n, cls, first = _looked_up(texts, words)
    sums = [np.add.reduceat(x, first[:-1]) if len(texts) else x for x in (n > 0, np.log10(n + 1.0))]
    raw, each = cls.astype(kind).tobytes(), kind.itemsize
    return pd.DataFrame({
        "doc_id": texts["doc_id"].astype("int64"), "n_tokens": np.diff(first), "n_known": sums[0].astype(np.int64), "sum_word": sums[1],
        "classes": [raw[each * a : each * b] for a, b in zip(first, first[1:], strict=False)],
    })


def _steps(batch: pa.RecordBatch, end: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class before and class of every word, and where texts begin; every text has its end at least."""
    column = batch.column("classes").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    cls = np.frombuffer(memoryview(column.buffers()[2])[offsets[0] : offsets[-1]], kind).astype(np.int64)
    first = ((offsets - offsets[0]) // kind.itemsize)[:-1]
    before = np.roll(cls, 1)
    before[first] = end
    return before, cls, first


def _moves(batches: Iterator[pa.RecordBatch], classes: int, end: int) -> Iterator[pa.RecordBatch]:
    """How often each class follows each class."""
    total = np.zeros(classes * classes, np.int64)
    for batch in batches:
        for part in slices([batch], "classes"):
            before, cls, _ = _steps(part, end, _number(classes))
            total += np.bincount(before * classes + cls, minlength=classes * classes)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["move", "n"])


def _weighed(batches: Iterator[pa.RecordBatch], weight: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
    """weight[class before, class]: log10 of the transition less log10 of the class' size."""
    names = ["doc_id", "n_tokens", "n_known", "sum_word"]
    for batch in batches:
        for part in slices([batch], "classes"):
            before, cls, first = _steps(part, end, _number(len(weight)))
            yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(np.add.reduceat(weight[before, cls], first))], names=[*names, "sum_class"])


def class_scores(
    docs: DataFrame, held_out: str = "crc32(cast(doc_id as string)) % 7 = 2", heads: int = 1000, tails: int = 256, least: int = 5, classes: int | None = None
) -> DataFrame:
    """Documents -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Words are lowered in A-Z; a text's end is one more token.  Documents for which held_out
    is true are scored but not learned from.  base_score: the sum of log10((c + 1) /
    (N + V + 1)) over unigrams; score: the class model's log10 probability of the text.
    classes: by default the cube root of the number of distinct words, within 16 to 256; no more than heads, tails and the end make up.

    Null and empty texts are an end alone.  Rows repeated under one doc_id are each
    counted and scored; rows with a null doc_id are left out; other columns are not read; an empty table gives no rows.
    Long texts are taken whole, as a slice and, beyond a chunk's words, a chunk of their own.  Among words equally common
    the one with the lesser hash is a head first; among equally likely classes a word takes the first.
    """
    source = ids_and_texts(docs)
    spark = docs.sparkSession
    train = source.where(f"not ({held_out})").select("text")
    per_task = train.mapInArrow(partial(_counted, tails=tails), schema("name long, tail int, n long"))
    counts = written(per_task.groupBy("name").agg(F.sum("n").alias("n"), F.min("tail").alias("tail")), "counts")
    n_tokens, n_words = counts.agg(F.sum("n"), F.count("*")).first()
    n_tokens = n_tokens or 0
    # at most `heads` words
    top = counts.orderBy(F.desc("n"), "name").limit(heads).select("name").toArrow().to_pandas()["name"].to_numpy(np.int64).view(np.uint64)
    top = np.unique(np.append(top, END))
    units = len(top) + tails
    classes = min(units, classes or int(np.clip(round(n_words ** (1 / 3)), 16, 256)))

    paired = train.mapInArrow(partial(_pairs, heads=top, tails=tails), schema("pair long, n long")).groupBy("pair").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    pairs = np.zeros(units * units)
    pairs[paired["pair"]] = paired["n"]
    pairs = pairs.reshape(units, units)
    cls = exchange_clusters(pairs, classes)
    cls = np.unique(cls, return_inverse=True)[1]
    classes = int(cls.max()) + 1
    of_tail, end = cls[len(top) :], int(cls[np.searchsorted(top, END)])

    # the other words: what stands before them, a row of at most NEAR numbers each
    near = np.unique(exchange_clusters(pairs, min(NEAR, classes)), return_inverse=True)[1]
    found = train.mapInArrow(partial(_contexts, heads=top, tails=tails, near=near), schema("name long, code int, n long")).repartition(partitions(spark), "name")
    found = found.groupBy("name", "code").agg(F.sum("n").alias("n")).groupBy("name").agg(F.collect_list(F.struct("code", "n")).alias("found"))
    with recorded(contexts := []):
        vectors = written(found.join(counts.where(F.col("n") >= least).select("name", "tail"), "name"), "contexts")
    spread = np.eye(classes)[cls]
    placed = word_classes(vectors, np.eye(int(near.max()) + 1)[near].T @ pairs @ spread, of_tail)
    kept = F.broadcast(spark.createDataFrame(list(zip(top.view(np.int64).tolist(), cls[: len(top)].tolist(), strict=True)), "name long, head int"))
    by_tail = literal_array(of_tail.tolist(), "int")[F.col("tail")]
    words = counts.join(placed, "name", "left").join(kept, "name", "left").select("name", "n", F.coalesce("head", "class", by_tail).alias("class"))
    words = written(words, "words")
    for path in contexts:
        drop(spark, path)

    with recorded(chunks := []):
        rows = written(source.mapInArrow(partial(_chunked, tails=tails), schema("chunk long, doc_id long, words binary, names array<long>, tails array<int>")), "chunks")
    asked = rows.where("doc_id is null").select("chunk", F.posexplode(F.arrays_zip("names", "tails")).alias("place", "x")).select("chunk", "place", F.col("x.names").alias("name"), F.col("x.tails").alias("tail"))
    known = asked.join(words, "name", "left").select(F.col("chunk").alias("of_chunk"), "place", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", by_tail).alias("class"))
    # only the answers travel with the texts, and only once
    texts = rows.where("doc_id is not null").select("chunk", "doc_id", "words")
    classed = texts.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInPandas(partial(_classed, kind=_number(classes)), schema("doc_id long, n_tokens long, n_known long, sum_word double, classes binary"))
    classed = written(classed, "classed")
    # what only led here is not kept beside it
    for path in chunks:
        drop(spark, path)
    moved = classed.where(f"not ({held_out})").select("classes").mapInArrow(partial(_moves, classes=classes, end=end), schema("move long, n long"))
    moved = moved.groupBy("move").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    moves = np.zeros(classes * classes)
    moves[moved["move"]] = moved["n"]
    moves = moves.reshape(classes, classes)
    # how many words each class has
    sizes = np.zeros(classes)
    for r in words.groupBy("class").count().collect():
        sizes[r["class"]] = r["count"]
    transition = np.log10((moves + 1) / (moves.sum(axis=1, keepdims=True) + classes))
    weight = transition - np.log10(moves.sum(axis=0) + sizes + 1)

    scored = classed.mapInArrow(partial(_weighed, weight=weight, end=end), schema("doc_id long, n_tokens long, n_known long, sum_word double, sum_class double"))
    base = F.col("sum_word") - F.col("n_tokens") * F.lit(float(np.log10(n_tokens + n_words + 1)))
    score = F.col("sum_word") + F.col("sum_class")
    return scored.select(
        "doc_id", F.expr(held_out).alias("held_out"), "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
