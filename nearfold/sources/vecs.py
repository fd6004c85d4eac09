"""Vector file formats as Spark data sources: fvecs, ivecs, bvecs, i8bin and i32bin.

    register(spark)
    spark.read.format("fvecs").load(path)            # vec_id, embedding
    df.write.format("fvecs").mode("append").save(path)

Reading is split into ranges of records; each task opens the file by
pyarrow.fs, so a path can be local, shared or in an object store. All integers
are little-endian. A file whose records differ in dimension, or that ends inside
a record, is an error. Each partition writes one file, its rows in order of vec_id; a
folder of files is read in name order. Appended files come after those that are
there; overwriting replaces them once all new ones are written. Vectors of a file
have one dimension; null vectors are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Records read by one task.
ROWS = 65_536
#: Number type of each format, and what is subtracted from its values.
ELEMENTS = {"fvecs": ("<f4", 0), "ivecs": ("<i4", 0), "bvecs": ("u1", 128), "i8bin": ("i1", 0), "i32bin": ("<i4", 0)}
SPARK_TYPE = {"fvecs": "float", "ivecs": "int", "bvecs": "tinyint", "i8bin": "tinyint", "i32bin": "int"}


def _files(path: str):
    """The file system and the files at a path, by name."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        return system, sorted((x.path, x.size) for x in system.get_file_info(fs.FileSelector(at)) if x.is_file and not x.base_name.startswith(("_", ".")))
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return system, [(at, info.size)]


@dataclass
class Part(InputPartition):
    path: str
    offset: int
    rows: int
    dim: int
    first: int


class _Reader(DataSourceReader):
    def __init__(self, options, kind: str):
        self.path, self.kind = options["path"], kind
        self.rows = int(options.get("rowsPerTask", ROWS))
        self.dtype, self.minus = ELEMENTS[kind]
        self.headed = kind.endswith("bin")

    def _shape(self, system, at: str, size: int) -> tuple[int, int]:
        """Records and dimension of a file, checked against its size."""
        width = np.dtype(self.dtype).itemsize
        with system.open_input_file(at) as f:
            head = f.read(8 if self.headed else 4)
        if len(head) < (8 if self.headed else 4):
            if not size:
                return 0, 0
            raise ValueError(f"{at}: no header")
        if self.headed:
            n, d = np.frombuffer(head, "<i4").tolist()
            if n < 0 or d < 1 or size != 8 + n * d * width:
                raise ValueError(f"{at}: {size} bytes do not hold {n} x {d} values")
            return n, d
        d = int(np.frombuffer(head, "<i4")[0])
        if d < 1 or size % (4 + d * width):
            raise ValueError(f"{at}: {size} bytes are no whole records of dimension {d}")
        return size // (4 + d * width), d

    def partitions(self):
        system, files = _files(self.path)
        out, first = [], 0
        for at, size in files:
            n, d = self._shape(system, at, size)
            record = (0 if self.headed else 4) + d * np.dtype(self.dtype).itemsize
            for lo in range(0, n, self.rows):
                out.append(Part(at, (8 if self.headed else 0) + lo * record, min(self.rows, n - lo), d, first + lo))
            first += n
        return out

    def read(self, part: Part):
        from pyarrow import fs

        if part is None:  # no records
            return
        system, _ = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        fields = ([] if self.headed else [("d", "<i4")]) + [("v", self.dtype, (part.dim,))]
        dtype = np.dtype(fields)
        with system.open_input_file(part.path) as f:
            f.seek(part.offset)
            data = f.read(part.rows * dtype.itemsize)
        if len(data) != part.rows * dtype.itemsize:
            raise ValueError(f"{part.path}: it ends inside a record")
        rows = np.frombuffer(data, dtype)
        if not self.headed and (rows["d"] != part.dim).any():
            raise ValueError(f"{part.path}: records differ in dimension")
        values = rows["v"].reshape(part.rows, part.dim)
        if self.minus:
            values = (values.astype(np.int16) - self.minus).astype(np.int8)
        flat = pa.array(np.ascontiguousarray(values).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(part.rows + 1, dtype=np.int32) * part.dim), flat)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first, part.first + part.rows, dtype=np.int64)), lists], names=["vec_id", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    path: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], kind, overwrite
        self.dtype, self.minus = ELEMENTS[kind]

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")

    def write(self, batches):
        import uuid

        from pyspark import TaskContext

        rows = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pydict({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.int8()))})])
        if not rows.num_rows:
            return Written("")
        rows = rows.sort_by("vec_id").combine_chunks()
        lists = rows.column("embedding").combine_chunks()
        sizes = np.unique(lists.value_lengths().to_numpy(zero_copy_only=False))
        if lists.null_count or len(sizes) != 1:
            raise ValueError("vectors to be written must not be null, and of one dimension")
        values = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), int(sizes[0]))
        if self.minus:
            values = values.astype(np.int16) + self.minus
        system, at = self._place()
        system.create_dir(at, recursive=True)
        name = f"{at}/.part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        with system.open_output_stream(name) as f:
            if self.kind.endswith("bin"):
                f.write(np.array(values.shape, "<i4").tobytes())
            for lo in range(0, len(values), ROWS):
                part = values[lo : lo + ROWS].astype(self.dtype)
                if not self.kind.endswith("bin"):
                    records = np.empty(len(part), [("d", "<i4"), ("v", self.dtype, (part.shape[1],))])
                    records["d"], records["v"] = part.shape[1], part
                    part = records
                f.write(part.tobytes())
        return Written(name)

    def commit(self, messages):
        """Files show up under their final names only once all tasks are done. Names begin with the number of the write, so later writes are read later."""
        from pyarrow import fs

        system, at = self._place()
        system.create_dir(at, recursive=True)
        old = [x.path for x in system.get_file_info(fs.FileSelector(at)) if x.is_file and not x.base_name.startswith(("_", "."))]
        numbers = [int(n) for p in old if (n := p.rpartition("/")[2].split("-")[0]).isdigit()]
        write = 0 if self.overwrite else max(numbers, default=-1) + 1
        if self.overwrite:
            for path in old:
                system.delete_file(path)
        for m in messages:
            if m and m.path:
                folder, _, name = m.path.rpartition("/")
                system.move(m.path, f"{folder}/{write:06d}-{name[1:]}.{self.kind}")

    def abort(self, messages):
        system, _ = self._place()
        for m in messages:
            if m and m.path:
                system.delete_file(m.path)


class _Source(DataSource):
    kind = ""

    @classmethod
    def name(cls):
        return cls.kind

    def schema(self):
        return f"vec_id long, embedding array<{SPARK_TYPE[self.kind]}>"

    def reader(self, schema):
        return _Reader(self.options, self.kind)

    def writer(self, schema, overwrite):
        return _Writer(self.options, self.kind, overwrite)


class Fvecs(_Source):
    kind = "fvecs"


class Ivecs(_Source):
    kind = "ivecs"


class Bvecs(_Source):
    kind = "bvecs"


class I8bin(_Source):
    kind = "i8bin"


class I32bin(_Source):
    kind = "i32bin"


def register(spark) -> None:
    for source in (Fvecs, Ivecs, Bvecs, I8bin, I32bin):
        spark.dataSource.register(source)


def read_truth(spark, path: str):
    """qid, rank, vec_id from an ivecs or i32bin file of ascending neighbours."""
    from pyspark.sql import functions as F

    register(spark)
    rows = spark.read.format("i32bin" if path.endswith("i32bin") else "ivecs").load(path)
    return rows.select(F.col("vec_id").alias("qid"), F.posexplode("embedding").alias("rank", "id")).select("qid", (F.col("rank") + 1).alias("rank"), F.col("id").cast("long").alias("vec_id"))


def read_id_map(spark, path: str):
    """local_id, global_id from an i32bin file."""
    from pyspark.sql import functions as F

    register(spark)
    return spark.read.format("i32bin").load(path).select(F.col("vec_id").alias("local_id"), F.col("embedding")[0].cast("long").alias("global_id"))


def not_increasing(id_map):
    """Entries of an id map that are not above their predecessor. Predecessors are found by position, so a join serves and no order over all rows is needed."""
    from pyspark.sql import functions as F

    before = id_map.select((F.col("local_id") + 1).alias("local_id"), F.col("global_id").alias("before"))
    return id_map.join(before, "local_id").where("before >= global_id")
