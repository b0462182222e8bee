"""Token ids in binary files: frequency-ranked ids, variable-length bytes, control bytes apart.

Every text is encoded once, into compressed ids that are written to the shared folder; ids are counted over that table and replaced by their rank, so the 256 most frequent take one
byte and nearly all others two. Texts are not shuffled, their ids are. Four ranks share a control byte, two bits each for the number of
bytes less one; control bytes and data bytes stand in blocks of their own. A reader looks the control
bytes up in a table of 256 rows, sums the lengths, and gathers all ranks at once with numpy.

Documents are dealt by ranges of their id and sorted, so files follow each other in ascending order;
a file closes at ``FILE_IDS`` ids, however large the table. Tasks write to the shared folder under
names of their own; the manifest lists only the files of tasks that succeeded, with the number of
ids before each file. Of the corpus the driver sees one count per vocabulary id.

Null text has only the end id. A NULL document id comes first; repeated ids stand side by side, in
the order of their texts' checksums; an empty table gives an empty manifest; a text is encoded whole
whatever its length, in a file of its own if it is longer than a file. Extra columns are ignored
whatever their names. Folders must be reachable through ``pyarrow.fs`` from every executor.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rubrica.llm.common import read, text_of, written
from rubrica.llm.tokens import default_vocabulary, encoder
from rubrica.session import fresh_path

END_ID = 1
#: Ids after which a file is closed.
FILE_IDS = 1 << 21
MAGIC = b"RKID0001"
#: Lengths of the four values of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = ranks.astype("<u4")
    sizes = 1 + (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = sizes - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) < sizes[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again: lengths by table lookup, then one gather per byte place."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count].astype(np.int64)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = np.cumsum(sizes) - sizes
    values = raw[at].astype(np.uint32)
    for place in range(1, 4):
        own = np.flatnonzero(sizes > place)
        if not len(own):
            break
        values[own] |= raw[at[own] + place].astype(np.uint32) << np.uint32(8 * place)
    return values


def pack_file(docs: list[int | None], lengths: list[int], ranks: np.ndarray) -> bytes:
    control, data = encode(ranks)
    known = np.array([d is not None for d in docs], np.uint8)
    ids = np.array([d or 0 for d in docs], "<i8")
    head = MAGIC + struct.pack("<QQQQ", len(docs), len(ranks), len(control), len(data))
    return b"".join([head, ids.tobytes(), known.tobytes(), np.array(lengths, "<u8").tobytes(), control, data])


def unpack_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ranks of a file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    n, total, n_control, n_data = struct.unpack_from("<QQQQ", raw, 8)
    at = 40
    ids = np.frombuffer(raw, "<i8", n, at).tolist()
    known = np.frombuffer(raw, np.uint8, n, at + 8 * n)
    lengths = np.frombuffer(raw, "<u8", n, at + 9 * n).astype(np.int64)
    at += 17 * n
    control, data = raw[at : at + n_control], raw[at + n_control : at + n_control + n_data]
    if len(data) != n_data:
        raise ValueError("token file is cut short")
    return [d if k else None for d, k in zip(ids, known)], lengths, decode(control, data, total)


def _width(vocabulary: str | None, end_id: int) -> tuple[int, str]:
    """Number of ids, and the integers that hold them."""
    size = max(encoder(vocabulary or default_vocabulary()).tokenizer.get_vocab_size(), end_id + 1)
    return size, "<u2" if size <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc, tie, ids) of every document: its ids, the end id included, compressed; ``tie`` orders equal documents.

    The rows are written to the shared folder and read back, as counting and writing both need them.
    """
    path, (_, kind) = vocabulary or default_vocabulary(), _width(vocabulary, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pack = encoder(path), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            found = words.encode_all(v.as_py() for v in batch.column("_text"))
            ids = [pack(np.append(own, np.uint32(end_id)).astype(kind).tobytes()) for own in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tie"), pa.array(ids, pa.binary())], names=["doc", "tie", "ids"])

    own = text_of(text)
    source = docs.select(F.col(id_column).cast("bigint").alias("doc"), F.crc32(own).alias("tie"), own.alias("_text"))
    return written(source.mapInArrow(run, "doc bigint, tie bigint, ids binary"), "ids")


def _ids_of(batch: pa.RecordBatch, kind: str) -> Iterator[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    for ids in batch.column("ids"):
        yield np.frombuffer(unpack(ids.as_py()), kind)


def ranked_ids(rows: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> np.ndarray:
    """Ids by falling frequency over all rows of ``encoded``, ties and unused ids by id. Each task counts into
    an array of the vocabulary's size; only sums per id leave it."""
    size, kind = _width(vocabulary, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(np.concatenate(list(_ids_of(batch, kind))), minlength=size) if batch.num_rows else 0
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["id", "n"])

    counted = rows.select("ids").mapInArrow(run, "id bigint, n bigint")
    counts = np.zeros(size, np.int64)
    for r in counted.groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return np.lexsort((np.arange(size), -counts)).astype(np.uint32)


def write_files(rows: DataFrame, folder: str, by_rank: np.ndarray, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of every row of ``encoded`` to ``folder`` and return the manifest, in order of the files:
    part, file, path, n_docs, n_ids, start (ids before the file)."""
    spark = rows.sparkSession
    kind = "<u2" if len(by_rank) <= 1 << 16 else "<u4"
    rank = np.empty(len(by_rank), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)
    ranged = rows.repartitionByRange("doc", "tie").sortWithinPartitions("doc", "tie").select("doc", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        own: tuple[list, list, list] = ([], [], [])
        number = held = 0

        def close() -> pa.RecordBatch:
            nonlocal own, number, held
            name = f"{root}/ids-{part:06d}-{number:05d}-{uuid.uuid4().hex}.bin"
            with store.open_output_stream(name) as out:
                out.write(pack_file(own[0], own[1], np.concatenate(own[2])))
            row = [part, number, name, len(own[0]), held]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            own, number, held = ([], [], []), number + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["part", "file", "path", "n_docs", "n_ids"])

        for batch in batches:
            for doc, ids in zip(batch.column("doc").to_pylist(), _ids_of(batch, kind)):
                own[0].append(doc)
                own[1].append(len(ids))
                own[2].append(ranks[ids])
                held += len(ids)
                if held >= file_ids:
                    yield close()
        if held:
            yield close()

    found = ranged.mapInArrow(run, "part int, file int, path string, n_docs bigint, n_ids bigint")
    # written once: a second run of the tasks would write a second set of files
    files = written(found, "manifest")
    # a part's files are numbered by its own task; only one sum per part is added up in order
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_own"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("_within", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part")
    return placed.select(*files.columns, (F.col("_start") + F.col("_within")).alias("start"))


def read_files(manifest: DataFrame, folder: str, by_rank: np.ndarray, id_column: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """The documents of the files: document, start (ids of all documents before), n_tokens,
    ids_crc32 and, with ``with_ids``, the ids."""
    shared = manifest.sparkSession.sparkContext.broadcast(by_rank)
    numbers = ["start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = shared.value
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_stream(name) as file:
                    docs, lengths, ranks = unpack_file(file.read())
                ids = ids_of[ranks].astype("<u4")
                ends = np.cumsum(lengths)
                own = [ids[a:b] for a, b in zip(ends - lengths, ends)]
                columns = [
                    pa.array(docs, pa.int64()),
                    pa.array(base + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(i.tobytes()) for i in own], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([i.astype(np.int32) for i in own], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[id_column, *numbers, *(["ids"] if with_ids else [])])

    schema = f"`{id_column}` bigint, " + ", ".join(f"{n} bigint" for n in numbers) + (", ids array<int>" if with_ids else "")
    # the manifest is small, its files are not: a fixed number of partitions keeps them from being merged
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(tasks, "path").mapInArrow(run, schema)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    folder = fresh_path(spark, "tokens")
    rows = encoded(docs)
    by_rank = ranked_ids(rows)
    return read_files(write_files(rows, folder, by_rank), folder, by_rank, with_ids=False)
