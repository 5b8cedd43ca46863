"""Token counts of whole texts for a byte-level BPE with the usual pattern of words
('s|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?others|white space but its last|white space).

Overlap resynchronisation.  A huge text is cut into chunks that reach `overlap` characters into the next one.  Each is encoded for
itself, in whatever task, with offsets.  Where both chunks begin a pre-token at the same place of the overlap, they go on alike:
the pattern never looks back, so from there on the later chunk has the whole text's tokens; and as the place lies further from the earlier chunk's end than
the pattern or a special string can look ahead, that chunk has them up to there.  The counts are spliced at the first such place.
Where there is none (a run of letters longer than the overlap, say) the earlier chunk's overlap is widened by the whole chunk behind it, and so on
until every neighbour is aligned.

Other texts are encoded in one go.  There a worker encodes each distinct unit once: a space in front of a visible character always begins a
pre-token, so texts are cut there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spans import Spans
from .tables import ids_and_texts, schema, written
from .text import slices

CHUNK, OVERLAP = 32_768, 512
_CACHED_UNITS = 2_000_000
#: characters that the pattern may look at behind a place where it has ended a pre-token
_LOOK = 3
_COUNTED = "doc_id long, n_bytes long, n_tokens long, key long, chunk int, start long, size int, last boolean, body string"
_ENCODED = "key long, chunk int, behind int, last boolean, n_tokens long, head array<struct<at:long,before:long>>, tail array<struct<at:long,before:long>>"

# bytes that begin a visible character: printable ASCII, and first bytes of characters none of which is white space
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:0xF5] = True
_VISIBLE[[0xE1, 0xE2, 0xE3]] = False


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.zeros(len(data) + 1, bool)
    cut[: max(0, len(data) - 1)] = (data[:-1] == 32) & _VISIBLE[data[1:]]
    cut[offsets] = True
    places = np.flatnonzero(cut)
    return places[:-1], places[1:]


class _Counter:
    """Numbers of tokens by unit, kept for the units met so far in this worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.margin = max([_LOOK, *(len(x.content) for x in self.tokenizer.get_added_tokens_decoder().values())])
        self.names, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        units = Spans(texts, _units)
        names, first, place = np.unique(units.names(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.names, names)
        known = at < len(self.names)
        known[known] = self.names[at[known]] == names[known]
        each = np.zeros(len(names), np.int64)
        each[known] = self.size[at[known]]
        new = first[~known]
        if len(new):
            data = units.data.tobytes()
            cuts = zip(units.starts[new].tolist(), units.ends[new].tolist(), strict=True)
            got = self.tokenizer.encode_batch_fast([data[a:b].decode() for a, b in cuts], add_special_tokens=False)
            each[~known] = np.fromiter((len(e.ids) for e in got), np.int64, len(new))
            if len(self.names) > _CACHED_UNITS:
                self.names, self.size = names[~known], each[~known]
            else:
                self.names, self.size = np.insert(self.names, at[~known], names[~known]), np.insert(self.size, at[~known], each[~known])
        return np.diff(np.concatenate([[0], np.cumsum(each[place])])[units.first])


@lru_cache(2)
def counter(path: str) -> _Counter:
    return _Counter(path)


def _counted(batches: Iterator[pa.RecordBatch], path: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    count, part, huge = counter(path), TaskContext.get().partitionId(), 0
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("key", pa.int64()), ("chunk", pa.int32()), ("start", pa.int64()), ("size", pa.int32()), ("last", pa.bool_()), ("body", pa.string())])
    for batch in slices(batches, "text"):
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        short = batch.filter(pa.array(sizes <= chunk))
        if short.num_rows:
            n = short.num_rows
            columns = [short.column("doc_id"), pa.array(sizes[sizes <= chunk], pa.int64()), pa.array(count(short.column("text")))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, f.type) for f in list(kinds)[3:])], schema=kinds)
        for i in np.flatnonzero(sizes > chunk).tolist():
            doc, text = batch.column("doc_id")[i].as_py(), batch.column("text")[i].as_py()
            key = part << 36 | huge
            huge += 1
            for k, at in enumerate(range(0, len(text), chunk)):
                last = at + chunk >= len(text)
                row = [doc, int(sizes[i]) if last else 0, None, key, k, at, min(chunk, len(text) - at), last, text[at : at + chunk + overlap]]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, kinds, strict=True)], schema=kinds)


def chunk_counts(count: _Counter, body: str, start: int, size: int, overlap: int, last: bool) -> tuple[int, list[dict], list[dict]]:
    """Tokens of a chunk, and where pre-tokens begin in the overlap at its head and at its tail, with the tokens before them."""
    found = count.tokenizer.encode(body, add_special_tokens=False)
    words = np.array(found.word_ids, np.int64)
    turn = np.flatnonzero(np.diff(words, prepend=-1) != 0) if len(words) else words
    at = np.array([x[0] for x in found.offsets], np.int64)[turn]
    ends = [at < overlap, (at >= size) & (at <= len(body) - count.margin)]
    head, tail = ([{"at": a + start, "before": b} for a, b in zip(at[m].tolist(), turn[m].tolist(), strict=True)] for m in ends)
    return len(words), head, [] if last else tail


def _encoded(batches: Iterator[pa.RecordBatch], path: str, overlap: int) -> Iterator[pa.RecordBatch]:
    count = counter(path)
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), *[pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))] * 2]
    for batch in slices(batches, "body"):
        for row in batch.to_pylist():
            n, head, tail = chunk_counts(count, row["body"], row["start"], row["size"], overlap, row["last"])
            out = [row["key"], row["chunk"], row["behind"], row["last"], n, head, tail]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kinds, strict=True)], names=["key", "chunk", "behind", "last", "n_tokens", "head", "tail"])


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """One chunk out of neighbours; the last one's overlap stays."""
    rows = rows.sort_values("chunk")
    bodies = [b[:n] for b, n in zip(rows["body"][:-1], rows["size"][:-1], strict=True)] + [rows["body"].iloc[-1]]
    whole = rows.iloc[[0]].drop(columns="group")
    return whole.assign(behind=rows["behind"].iloc[-1], size=rows["size"].sum(), last=rows["last"].iloc[-1], body="".join(bodies))


def _spliced(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """key, n: the tokens of each huge text."""
    columns = ["key", "chunk", "behind", "start", "size", "last", "body"]
    left = chunks.withColumn("behind", (F.col("chunk") + 1).cast("int")).select(*columns)
    encode = partial(_encoded, path=path, overlap=overlap)
    done = written(left.repartition("key", "chunk").mapInArrow(encode, schema(_ENCODED)), "encoded-chunks")
    while True:
        after = done.select("key", F.col("chunk").alias("behind"), F.col("head").alias("next_head"))
        places = F.array_intersect(F.transform("tail", lambda x: x["at"]), F.transform("next_head", lambda x: x["at"]))
        pairs = done.where("not last").join(after, ["key", "behind"]).withColumn("place", F.array_min(places))
        failed = pairs.where("place is null").select("key", F.col("behind").alias("chunk"), F.lit(True).alias("joins"))
        failed = written(failed, "unaligned")
        if failed.isEmpty():
            break
        # a text has at most 2 GB, so its chunks are few
        order = Window.partitionBy("key").orderBy("chunk")
        marked = left.join(failed, ["key", "chunk"], "left").withColumn("group", F.last(F.when(F.col("joins").isNull(), F.col("chunk")), ignorenulls=True).over(order))
        marked = written(marked.withColumn("many", F.max("joins").over(Window.partitionBy("key", "group")).isNotNull()), "joined-chunks")
        wide = written(marked.where("many").select(*columns, "group").groupBy("key", "group").applyInPandas(_joined, left.schema), "widened")
        kept = marked.where("not many").select(*columns)
        stays = done.join(kept.select("key", "chunk"), ["key", "chunk"], "left_semi")
        done = written(stays.unionByName(wide.mapInArrow(encode, schema(_ENCODED))), "encoded-chunks")
        left = kept.unionByName(wide)

    def before(where: str) -> F.Column:
        return F.filter(where, lambda x: x["at"] == F.col("place"))[0]["before"]

    parts = pairs.select("key", (before("tail") - before("next_head")).alias("n")).unionByName(done.where("last").select("key", F.col("n_tokens").alias("n")))
    return parts.groupBy("key").agg(F.sum("n").alias("n"))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Documents -> doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    tokenizer: the file of a byte-level BPE for the tokenizers library.  No special tokens are added, nothing is cut off or filled up; special strings inside texts are
    special tokens, as the library has it.  Texts of more than `chunk` bytes are cut into chunks of so many characters, which overlap by `overlap`
    (at most a chunk, and more than the longest special string).

    Null and empty texts have no tokens; very long ones are counted whole, in chunks that any task may take.  Rows repeated under one doc_id are counted each; rows with a null
    doc_id are left out; other columns are not read; an empty table gives no rows.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap must be positive and at most a chunk")
    rows = written(ids_and_texts(docs).mapInArrow(partial(_counted, path=tokenizer, chunk=chunk, overlap=overlap), schema(_COUNTED)), "token-counts")
    counts = rows.where("key is null").select("doc_id", "n_bytes", "n_tokens")
    huge = rows.where("key is not null")
    if not huge.isEmpty():
        whole = huge.where("last").select("key", "doc_id", "n_bytes").join(_spliced(huge, tokenizer, overlap), "key")
        counts = counts.unionByName(whole.select("doc_id", "n_bytes", F.col("n").alias("n_tokens")))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
