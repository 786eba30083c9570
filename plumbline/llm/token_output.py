"""Token-ID output: Arrow IPC files of fixed-size-list batches, readable at random without copies.

Each task encodes its texts, joins them with an end-of-text id between documents, cuts the stream into sequences of
``length`` ids and writes them in record batches of ``batch_rows`` sequences: ``input_ids``
(fixed_size_list<uint16>, uint32 for larger vocabularies) and ``mask`` (fixed_size_list<uint8>, 0 on the padding
of a file's last sequence). Nothing is shuffled or sent to the driver but one index row per row of the table. Files carry
the task attempt's number, and the index names those of attempts that succeeded, so a lost executor or a
speculative copy leaves at most an unnamed file.

Defined results: null and empty texts have no ids; they get an index row with 0 tokens. Null ids are kept; ``key``
(the hash of id and text) tells rows of null or repeated ids apart. Repeated rows are written each. An empty table gives no files and no rows. A text of any length is written whole, over as
many sequences as it takes. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.bpe import VOCABULARY, encoder, text_groups
from plumbline.llm.common import map_text, materialize, scratch_path

LENGTH, BATCH_ROWS = 1024, 256


def schema(dtype: np.dtype, length: int) -> pa.Schema:
    """The files' schema."""
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.uint8(), length))])


class SequenceWriter:
    """Writes a stream of ids as sequences to one file."""

    def __init__(self, uri: str, dtype: np.dtype, length: int, batch_rows: int) -> None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.schema, self.length, self.rows = schema(dtype, length), length, batch_rows
        self.stream = system.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.stream, self.schema)
        self.buffer, self.held, self.dtype = [], 0, dtype

    def add(self, ids: np.ndarray) -> None:
        self.buffer.append(ids)
        self.held += len(ids)
        full = self.length * self.rows
        if self.held >= full:
            rest = np.concatenate(self.buffer)
            whole = len(rest) // full * full
            for k in range(0, whole, full):
                self._write(rest[k : k + full], np.ones(full, np.uint8))
            self.buffer, self.held = [rest[whole:].copy()], len(rest) - whole

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.concatenate(self.buffer)
            pad = -len(ids) % self.length
            self._write(np.concatenate((ids, np.zeros(pad, self.dtype))), np.concatenate((np.ones(len(ids), np.uint8), np.zeros(pad, np.uint8))))
        self.writer.close()
        self.stream.close()


class Sequences:
    """Random access to one file: views into its memory map."""

    def __init__(self, path: str) -> None:
        self.reader = pa.ipc.open_file(pa.memory_map(path.removeprefix("file://")))
        self.batches = [self.reader.get_batch(k) for k in range(self.reader.num_record_batches)]
        self.rows = self.batches[0].num_rows if self.batches else 1
        self.length = self.reader.schema.field("input_ids").type.list_size

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of a sequence, without a copy. All batches but the last have equally many rows."""
        batch, row = self.batches[i // self.rows], i % self.rows
        at = slice(row * self.length, (row + 1) * self.length)
        return tuple(batch.column(c).flatten().to_numpy(zero_copy_only=True)[at] for c in (0, 1))  # type: ignore[return-value]

    def document(self, start: int, n: int) -> np.ndarray:
        """The ids of a document from its index row."""
        if not n:
            return np.zeros(0, np.int64)
        parts = [self[k][0] for k in range(start // self.length, (start + n - 1) // self.length + 1)]
        return np.concatenate(parts)[start % self.length :][:n]


def _write_batches(folder: str, vocabulary: str, length: int, batch_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(vocabulary)
        end = np.array([own.size], dtype=own.dtype)
        context, writer, at, file = TaskContext.get(), None, 0, None
        for batch in batches:
            for i, j, data, offsets in text_groups(batch.column(2)):
                if writer is None:
                    file = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.arrow"
                    writer = SequenceWriter(file, own.dtype, length, batch_rows)
                ids, before = own.encode(data, offsets)
                n = np.diff(before)
                # an end id after each text that has any
                ends = np.cumsum(n > 0)
                out = np.insert(ids, before[1:][n > 0], end)
                starts = at + before[:-1] + ends - (n > 0)
                writer.add(out)
                at += len(out)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 1)), pa.array([file] * (j - i)), pa.array(starts), pa.array(n)], names=["doc_id", "key", "file", "start", "n_tokens"])
        if writer is not None:
            writer.close()

    return run


def write_tokens(docs: DataFrame, folder: str | None = None, length: int = LENGTH, batch_rows: int = BATCH_ROWS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Writes all documents and returns their index: ``doc_id``, ``key``, ``file``, ``start`` (in ids from the file's start) and ``n_tokens``.

    By default into a fresh folder within the shared one; ``folder`` must be a URI that all executors reach.
    """
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key"), "text")
    return materialize(map_text(rows, _write_batches(folder, vocabulary, length, batch_rows), "doc_id long, key long, file string, start long, n_tokens long"), "token-index")
