"""Token counts of documents in flat token files without an index.

A flat file is little-endian ids of 16 bits (of 32 for vocabularies beyond 65,536), one document after another, each closed by the
end-of-document id. The files are
scanned in blocks of fixed size, each a task's row: a vectorised search finds the closing ids in a block; what stands before its
first and after its last belongs to documents that cross it. A prefix scan over the blocks' counts (per file, by their order)
numbers the documents and stitches those that cross blocks.

Cases: a null or empty text is a document of no ids. Ids behind a file's last closing id are a document of their own, not closed.
Repeated rows and doc_ids stay apart. Very long texts may cross any number of blocks. An empty table gives no file and an empty result. Other columns of the input aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlens.llm.common import file_system, map_texts, pinned, scratch_path, write_file
from martlens.llm.tokens import Encoder, default_path

#: The token that closes a document.
END = "<|endoftext|>"


def end_id_of(tokenizer: str) -> int:
    """The id of the tokenizer's closing token."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer).token_to_id(END)
    if found is None:
        raise ValueError(f"{tokenizer} has no {END}: give end_id")
    return found


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end_id: int, file_tokens: int = 1 << 26) -> DataFrame:
    """(path, width, first, doc_ids) of the flat files of ``docs`` (doc_id, text); width: bytes of an id; doc_ids: the order in which they stand, in runs.

    The files themselves hold ids only. The list is what lets a query name the documents that a scan numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(tokenizer, plain=True)
        width = 2 if max(end_id, encoder.tokenizer.get_vocab_size() - 1) < 1 << 16 else 4

        def runs_() -> Iterator[tuple[list, np.ndarray]]:
            for batch in batches:
                for first, end, ids, counts in encoder.encode(batch.column(1)):
                    cut = np.cumsum(counts)
                    yield batch.column(0).slice(first, end - first).to_pylist(), np.insert(ids.astype(f"<u{width}"), cut, end_id)

        source = runs_()
        held = next(source, None)
        while held is not None:
            told: list[tuple[int, list]] = []

            def chunks(told=told):
                nonlocal held
                total = 0
                while held is not None and total < file_tokens:
                    told.append((total, held[0]))
                    total += len(held[1])
                    yield held[1].tobytes()
                    held = next(source, None)

            path = write_file(folder, "tokens", chunks())
            first = np.cumsum([0, *(len(ids) for _, ids in told)])[:-1].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(told)), pa.array([width] * len(told), pa.int32()), pa.array(first, pa.int64()), pa.array([ids for _, ids in told], pa.list_(pa.int64()))], ["path", "width", "first", "doc_ids"])

    return pinned(map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, "path string, width int, first long, doc_ids array<long>"), "flat")


def scan(files: DataFrame, end_id: int, block_tokens: int = 1 << 20) -> DataFrame:
    """(path, document, start, n_tokens, closed) of every document of the flat files of ``files`` (path, width), numbered from 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, width in (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            system, inner = file_system(path)
            total = system.get_file_info(inner).size // width
            at = np.arange(0, total, block_tokens)
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(at)), pa.array([width] * len(at), pa.int32()), pa.array(at), pa.array(np.minimum(block_tokens, total - at))], ["path", "width", "at", "n"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, width, at, n in (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            system, inner = file_system(path)
            with system.open_input_file(inner) as file:
                ends = at + np.flatnonzero(np.frombuffer(file.read_at(width * n, width * at), f"<u{width}") == end_id)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at]), pa.array([n]), pa.array([ends.tolist()], pa.list_(pa.int64()))], ["path", "at", "n", "ends"])

    blocks = files.select("path", "width").distinct().mapInArrow(cut, "path string, width int, at long, n long")
    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = pinned(blocks.repartition(tasks).mapInArrow(search, "path string, at long, n long, ends array<long>"), "ends")
    # The prefix scan runs over one short row a block; the documents' rows come after it.
    earlier = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    short = found.select("path", "at", "n", F.size("ends").alias("k"), F.when(F.size("ends") > 0, F.col("ends")[F.size("ends") - 1]).alias("last"))
    short = short.select("path", "at", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("opened"), (F.lead("at").over(Window.partitionBy("path").orderBy("at")).isNull()).alias("final"), (F.col("at") + F.col("n")).alias("stop"), "last")
    rows = found.select("path", "at", "ends").join(short, ["path", "at"])
    tail = F.coalesce("last", "opened") + 1
    ends = F.when(F.col("final") & (tail < F.col("stop")), F.concat("ends", F.array("stop"))).otherwise(F.col("ends"))
    rows = rows.select("path", "before", "opened", "stop", "final", ends.alias("ends"))
    starts = F.concat(F.array(F.col("opened") + 1), F.transform("ends", lambda e: e + 1))
    rows = rows.select("path", "before", "stop", "final", F.posexplode(F.arrays_zip(F.slice(starts, F.lit(1), F.size("ends")).alias("s"), F.col("ends").alias("e"))).alias("k", "x"))
    return rows.select("path", (F.col("before") + F.col("k")).alias("document"), F.col("x.s").alias("start"), (F.col("x.e") - F.col("x.s")).alias("n_tokens"), (F.col("x.e") < F.col("stop")).alias("closed"))


def count_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = None, block_tokens: int = 1 << 20) -> DataFrame:
    """doc_id, path, document, start, n_tokens of every row of ``docs``, from a scan of flat files written in the shared folder."""
    tokenizer = tokenizer or default_path()
    end_id = end_id_of(tokenizer) if end_id is None else end_id
    listed = write_flat(docs, scratch_path(docs.sparkSession, "tokens"), tokenizer, end_id)
    names = listed.select("path", "first", F.posexplode("doc_ids").alias("k", "doc_id")).select("path", (F.col("first") + F.col("k")).alias("document"), "doc_id")
    return scan(listed, end_id, block_tokens).join(names, ["path", "document"]).select("doc_id", "path", "document", "start", "n_tokens")
