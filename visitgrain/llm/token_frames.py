"""Token files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file holds one frame per document, in ascending order of the id, each the document's token ids as
little-endian unsigned integers of 16 bits, or of 32 where the vocabulary has more than 65,536 ids.
Two skippable frames follow: an index (bytes of an integer, then the documents' ids and whether they
are null), and the public seek table (compressed size, content size, and the low
32 bits of the content's XXH64 for each frame, then the number of frames, a descriptor and the
magic number). A reader seeks to the end, reads the table, and decompresses only the frames asked
for, checking each; a plain zstandard decoder reads the same file as one stream.

Writing: documents are encoded and compressed where they lie; the compressed frames, a fraction of
the text, are stored once and dealt by ranges of the id; each range becomes a file. A file is named
after the attempt that wrote it and counts only if the manifest names it, so lost or repeated tasks
leave no wrong file behind. The manifest gives each file's number of documents and tokens; running
sums of it place every document in the whole stream.

The folder is any store that pyarrow's file systems reach, and must be shared by the executors.

Defined results: a null or empty text is a document of the end id alone; rows with a null id come
first; rows that repeat an id are separate documents next to each other, ordered by their ids'
checksum; an empty table gives no file; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from visitgrain.llm.common import scan, settle, texts_of
from visitgrain.llm.pieces import PieceTable, distinct, joined, together

# Fixed values of the zstandard formats.
SKIPPABLE_SEEK, SKIPPABLE_INDEX = 0x184D2A5E, 0x184D2A50
SEEK_MAGIC, WITH_CHECKSUM = 0x8F92EAB1, 0x80

LEVEL = 3
#: Pieces that go through the library as one text.
LINES = 256
#: Rows, and characters of text, that are encoded together: the more, the fewer pieces are looked up again.
ROWS, TOGETHER = 4096, 8 << 20
#: Size of a file's compressed frames to aim for.
FILE_BYTES = 64 << 20

# The characters that the byte-level pattern takes for white space, and four more.
_WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BEFORE_WORD = re.compile(f" (?=[^{_WHITE}])")
_ANY_WHITE = re.compile(f"[{_WHITE}]")
#: A space that no word follows.
_ODD = re.compile(f" (?![^{_WHITE}])")


class PieceEncoder:
    """Encodes with the tokenizers library, one distinct piece of text once.

    A text is cut at each space that a word follows; the byte-level pattern always cuts there too,
    so the pieces' ids are the text's ids. Texts with other white space after a space, or with a
    special token, are cut more carefully or encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        largest = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.width = 2 if largest < 1 << 16 else 4
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.table = PieceTable(self._make)

    def _make(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces with a space before each.

        Many pieces without white space go through the library as one text, a line each: the
        pattern makes a token of its own of each line end, and that is where the ids are cut.
        """
        made: dict[str, bytes] = {}
        lines = [p for p in pieces if not _ANY_WHITE.search(p)]
        runs = [lines[i : i + LINES] for i in range(0, len(lines), LINES)]
        texts = ["\n".join([" " + p for p in run]) for run in runs]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.flatnonzero(ids == self.newline[0]).tolist()
            if len(ends) == len(run) - 1:
                raw = ids.tobytes()
                made.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(run, [0, *(x + 1 for x in ends)], [*ends, len(ids)]))
        alone = [p for p in pieces if p not in made]
        made.update(zip(alone, self._whole([" " + p for p in alone])))
        return [made[p] for p in pieces]

    def _whole(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in made]

    def _carefully(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._whole([text])[0]
        first, *pieces = _BEFORE_WORD.split(text)
        distinct_pieces = list(dict.fromkeys(pieces))
        ids = dict(zip(distinct_pieces, self.table.ids(distinct_pieces)))
        return self._whole([first])[0] + b"".join(map(ids.__getitem__, pieces))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [ids for run in together(texts, TOGETHER) for ids in self._run(run)]

    def _run(self, texts: list[str]) -> list[bytes]:
        careful = [bool(_ODD.search(t)) or any(s in t for s in self.special) for t in texts]
        plain = [t for t, c in zip(texts, careful) if not c]
        # What stands before the first space has no space of its own.
        heads = [t.partition(" ")[0] for t in plain]
        rest = [t[len(h) + 1 :] for t, h in zip(plain, heads)]
        some = [i for i, (t, h) in enumerate(zip(plain, heads)) if len(t) > len(h)]
        offsets, index, pieces = distinct(pc.split_pattern(pa.array([rest[i] for i in some], pa.string()), " "))
        tails = dict(zip(some, joined(offsets, index, self.table.ids(pieces))))
        made = iter([h + tails.get(i, b"") for i, h in enumerate(self._whole(heads))])
        return [self._carefully(t) if c else next(made) for t, c in zip(texts, careful)]


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def seek_table(entries: list[tuple[int, int, int]]) -> bytes:
    """The trailing frame for (compressed size, content size, checksum) of each frame."""
    body = b"".join(struct.pack("<III", *e) for e in entries)
    body += struct.pack("<IBI", len(entries), WITH_CHECKSUM, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_SEEK, len(body)) + body


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


class FrameFile:
    """Reads documents of one file by their place in it."""

    def __init__(self, path: str):
        store, place = _store(path)
        self.file = store.open_input_file(place)
        size = self.file.size()
        count, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEK_MAGIC or not descriptor & WITH_CHECKSUM:
            raise ValueError(f"{path}: no seek table")
        table = np.frombuffer(self.file.read_at(12 * count, size - 9 - 12 * count), "<u4").reshape(-1, 3)
        self.starts = np.concatenate(([0], table[:, 0].astype(np.int64).cumsum()))
        self.sizes, self.checksums = table[:, 1], table[:, 2]
        index_at = int(self.starts[-1])
        self.width = self.file.read_at(1, index_at + 8)[0]
        raw = self.file.read_at(9 * count, index_at + 9)
        nulls = np.frombuffer(raw[8 * count :], np.uint8)
        self.ids = [None if n else i for i, n in zip(np.frombuffer(raw[: 8 * count], "<i8").tolist(), nulls)]
        self.inflate = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, place: int) -> np.ndarray:
        """Token ids of one document; only its frame is read."""
        start, size = int(self.starts[place]), int(self.sizes[place])
        frame = self.file.read_at(int(self.starts[place + 1]) - start, start)
        raw = self.inflate.decompress(frame, max_output_size=max(size, 1))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checksums[place]:
            raise ValueError(f"checksum of frame {place}")
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def close(self) -> None:
        self.file.close()


def write_frames(
    docs: DataFrame,
    spark: SparkSession,
    folder: str,
    path: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the documents' tokens under ``folder`` and return the manifest.

    The manifest has ``file``, ``place`` (order of the files), ``n_docs``, ``n_tokens`` and
    ``first_token``, the number of tokens in all files before. ``path`` is the vocabulary file,
    installed at the same place on every executor.
    """
    width = encoder(path).width if end_id < 1 << 16 else 4
    end = np.array([end_id], "<u4").tobytes()

    def encode():
        coder = encoder(path)

        def narrow(raw: bytes) -> bytes:
            return raw if width == 4 else np.frombuffer(raw, "<u4").astype("<u2").tobytes()

        deflate = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

        def work(ids, texts):
            made = [narrow(m + end) for m in coder.encode(texts_of(texts))]
            return {
                "id": ids.cast(pa.int64()),
                "frame": ([deflate.compress(m) for m in made], pa.binary()),
                "size": ([len(m) for m in made], pa.int64()),
                "checksum": ([xxhash.xxh64_intdigest(m) & 0xFFFFFFFF for m in made], pa.int64()),
            }

        return work

    frames = settle(
        scan(
            docs,
            [id_col, text_col],
            encode,
            {"id": "bigint", "frame": "binary", "size": "bigint", "checksum": "bigint"},
            rows=ROWS,
        ),
        spark,
        "frames",
    )
    total = frames.agg(F.sum(F.length("frame").cast("bigint") + 64)).first()[0] or 0
    files = max(1, -(-total // file_bytes), min(spark.sparkContext.defaultParallelism, -(-total // (1 << 20))))
    dealt = frames.repartitionByRange(int(files), F.col("id").asc_nulls_first(), "checksum").sortWithinPartitions(
        F.col("id").asc_nulls_first(), "checksum", "size"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, out, entries, ids, tokens = TaskContext.get().partitionId(), None, [], [], 0
        for batch in batches:
            for i, frame, size, checksum in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{folder}/tokens-{place:05d}-{uuid.uuid4().hex[:12]}.zst"
                    store, where = _store(name)
                    store.create_dir(where.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(where, compression=None)
                out.write(frame)
                entries.append((len(frame), size, checksum))
                ids.append(i)
                tokens += size // width
        if out is None:
            return
        index = bytes([width]) + np.array([i or 0 for i in ids], "<i8").tobytes() + bytes(i is None for i in ids)
        out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index + seek_table(entries))
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([place], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([tokens], pa.int64())],
            names=["file", "place", "n_docs", "n_tokens"],
        )

    written = settle(dealt.mapInArrow(write, "file string, place bigint, n_docs bigint, n_tokens bigint"), spark, "manifest")
    # One row per file: small beside the files however many there are.
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_frames(manifest: DataFrame, id_col: str = "doc_id", whole: bool = True) -> DataFrame:
    """One row per document, read back from the files: id, ``start``, ``n_tokens``, ``ids_crc32`` and,
    where ``whole``, the ``ids`` (binary, little-endian unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(*(c.to_pylist() for c in batch.columns)):
                held = FrameFile(name)
                for low in range(0, len(held), 512):
                    rows = []
                    for place in range(low, min(low + 512, len(held))):
                        ids = held.document(place)
                        raw = ids.tobytes()
                        rows.append((held.ids[place], at, len(ids), zlib.crc32(raw), raw))
                        at += len(ids)
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.binary()])]
                    names = [id_col, "start", "n_tokens", "ids_crc32", "ids"]
                    n = 5 if whole else 4
                    yield pa.RecordBatch.from_arrays(columns[:n], names=names[:n])
                held.close()

    out = f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if whole else "")
    # As many tasks as files, dealt by range: one file to each, where a hash would give some several.
    files = manifest.select("file", "first_token", "place").repartitionByRange(max(manifest.count(), 1), "place")
    return files.select("file", "first_token").mapInArrow(read, out)


def read_documents(manifest: DataFrame, ids: Iterable[int], id_col: str = "doc_id") -> DataFrame:
    """Token ids of the documents with the given ids: only their frames are decompressed."""
    asked = frozenset(ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held = FrameFile(name)
                rows = [(i, held.document(p).tobytes()) for p, i in enumerate(held.ids) if i in asked]
                held.close()
                if rows:
                    a, b = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()), pa.array(b, pa.binary())], names=[id_col, "ids"]
                    )

    files = manifest.select("file").repartitionByRange(max(manifest.count(), 1), "file")
    return files.mapInArrow(read, f"`{id_col}` bigint, ids binary")
