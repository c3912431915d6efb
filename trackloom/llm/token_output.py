"""Token ids in Arrow files of equal-length sequences, for zero-copy random access.

The corpus is one stream of ids in ascending order of document id, cut into shards by ranges
of ids. A shard is an Arrow file (with footer, uncompressed) whose record batches hold
BATCH sequences each: ``ids`` and ``mask`` are fixed-size lists of the sequence length, so the
place of any token is arithmetic, and a memory map reads it without copying. The last sequence
of a shard is filled up with zeros where the mask is false. Beside it an index file keeps
(doc_id, start in the shard, n_tokens).

Shards are written under another name and renamed, so a task that is run again leaves a whole
file. The folder may be any that pyarrow.fs opens and all executors share.

Defined cases: a null or empty text is the end id alone; rows of equal id stand next to each
other, in any order; rows without id come first; an empty table gives no shards.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import written

LENGTH = 2048
BATCH = 64
END_ID = 1
MANIFEST = "shard int, path string, n_docs bigint, n_tokens bigint"
DOCUMENTS = "id {id}, start bigint, n_tokens bigint, ids_crc32 bigint"


class ShardWriter:
    """Appends documents to one shard; holds a batch of sequences in memory at most."""

    def __init__(self, sink, vocab: int, length: int = LENGTH, batch: int = BATCH):
        import numpy as np
        import pyarrow as pa

        self.kind = np.dtype("<u2") if vocab <= 1 << 16 else np.dtype("<u4")
        self.length, self.batch = length, batch
        ids = pa.list_(pa.from_numpy_dtype(self.kind), length)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list = []
        self.size = self.total = 0

    def append(self, ids) -> None:
        self.held.append(ids.astype(self.kind))
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= self.length * self.batch:
            self._flush(self.length * self.batch)

    def _flush(self, step: int) -> None:
        import numpy as np

        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        at = 0
        while len(flat) - at >= step > 0:
            self._write(flat[at : at + step], step)
            at += step
        self.held, self.size = [flat[at:]], len(flat) - at

    def _write(self, flat, tokens: int) -> None:
        import numpy as np
        import pyarrow as pa

        mask = np.arange(len(flat)) < tokens
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(lists, self.schema)], schema=self.schema))

    def close(self) -> None:
        import numpy as np

        flat = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        if len(flat):
            whole = -(-len(flat) // self.length) * self.length
            self._write(np.concatenate([flat, np.zeros(whole - len(flat), self.kind)]), len(flat))
        self.file.close()


class Shard:
    """Random access to a shard; of a local file by a memory map, without copies."""

    def __init__(self, path: str):
        import pyarrow as pa
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        self.source = pa.memory_map(inner) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self._open: tuple[int, object] = (-1, None)

    def batch(self, i: int):
        """The ids of a record batch, one after another, as a view of the file."""
        if self._open[0] != i:
            column = self.file.get_batch(i).column(0)
            self._open = (i, column.values.to_numpy(zero_copy_only=True)[column.offset * self.length : (column.offset + len(column)) * self.length])
        return self._open[1]

    def sequence(self, i: int):
        """(ids, mask) of a sequence."""
        ids = self.batch(i // self.rows)[(i % self.rows) * self.length :][: self.length]
        return ids, self.file.get_batch(i // self.rows).column(1)[i % self.rows].values.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int):
        """The ids from a place on, over as many sequences as they take."""
        import numpy as np

        step, found = self.rows * self.length, []
        while n:
            part = self.batch(start // step)[start % step :][:n]
            if not len(part):
                raise EOFError("the range ends beyond the shard")
            found.append(part)
            start, n = start + len(part), n - len(part)
        return found[0] if len(found) == 1 else np.concatenate(found) if found else self.batch(0)[:0]


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards and return their manifest (MANIFEST columns), in order of shard."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = given.repartitionByRange("id").sortWithinPartitions("id")

    def run(batches: Iterator) -> Iterator:
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        from trackloom.llm.tokens import encoder

        enc = encoder(tokenizer, end_id)
        shard = TaskContext.get().partitionId()
        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        name, own = f"{inner}/shard-{shard:06d}", uuid.uuid4().hex
        docs_n, out, index, sink = 0, None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                sink = [system.open_output_stream(f"{name}.{kind}.{own}") for kind in ("arrow", "index")]
                out = ShardWriter(sink[0], enc.tokenizer.get_vocab_size(), length)
                fields = pa.schema([("doc_id", batch.schema.field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_file(sink[1], fields)
            starts, sizes = [], []
            for ids in enc.encode(batch.column(1).to_pylist()):
                starts.append(out.total)
                sizes.append(len(ids) // 4)
                out.append(np.frombuffer(ids, "<u4"))
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=fields))
            docs_n += batch.num_rows
        if out is not None:
            out.close()
            index.close()
            for s in sink:
                s.close()
            for kind in ("arrow", "index"):
                if system.get_file_info(f"{name}.{kind}").type != fs.FileType.NotFound:
                    system.delete_file(f"{name}.{kind}")
                system.move(f"{name}.{kind}.{own}", f"{name}.{kind}")
            row = ([shard], [f"{folder}/shard-{shard:06d}"], [docs_n], [out.total])
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1]), pa.array(row[2], pa.int64()), pa.array(row[3], pa.int64())], ["shard", "path", "n_docs", "n_tokens"])

    return written(ordered.mapInArrow(run, MANIFEST), "manifest")


def read_documents(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read back from the shards; ``start``
    counts the ids of all documents before it. The sum over shards has a row for each shard."""
    based = manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("shard")) - F.col("n_tokens")).select("path", "base")

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(f"{path}.arrow")
                system, inner = fs.FileSystem.from_uri(f"{path}.index")
                index = pa.ipc.open_file(system.open_input_file(inner))
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    starts, sizes = part.column(1).to_pylist(), part.column(2).to_pylist()
                    crc = [zlib.crc32(shard.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(starts, sizes)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([base + s for s in starts], pa.int64()), part.column(2), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    shards = max(1, manifest.count())  # a number, so that small rows aren't merged into one task
    return based.repartition(shards).mapInArrow(run, DOCUMENTS.format(id=id_type))
