"""The labelled corpus as a data source (S1-S6): ``spark.read.format("labelled_corpus")``.

A partition is one ``part*`` folder of a side, so a retried task reads the same files in the same order (by name).
A text and its sidecar are read together: a sidecar is opened only where its text is. Filters on ``part`` and ``type``
(equality and ``IN``) leave whole folders unread; a sample is a bound in the order of parts and hashes, known to the
reader, so texts and sidecars outside it are not opened either.

Sidecars go through the standard library's strict parser: what is no well-formed document with one root, or has a
``plagiarism`` feature whose offset or length is no 32-bit integer, keeps ``language = 'unknown'`` alone. ``feature``
elements count at any depth below the root; the last ``about`` wins; annotations keep document order.

Defined cases: no sidecar, or one without a known feature, gives null metadata; undecodable bytes are dropped and line
ends become ``\\n``; an empty text is an empty string; a side without folders has no rows; a root with neither side is
refused. Files are read through Arrow's file systems (local, ``hdfs://``, ``s3://``, ``gs://``).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from palimpsest.schemas import METADATA_TYPE
from palimpsest.session import ship_package
from palimpsest.sources import corpus as C

FORMAT = "labelled_corpus"
LISTED = "path string, part string, id string, type string"
BATCH_BYTES = 4 << 20

_ANNOTATION = pa.struct([("source_reference", pa.string()), ("offset", pa.int32()), ("length", pa.int32()),
                         ("type", pa.string()), ("obfuscation", pa.string())])
_METADATA = pa.struct([("authors", pa.string()), ("title", pa.string()), ("language", pa.string()),
                       ("plagiarism", pa.list_(_ANNOTATION))])
_LISTED = [(c, pa.string()) for c in ("path", "part", "id", "type")]
_WHOLE = [*_LISTED, ("raw_text", pa.string()), ("metadata", _METADATA)]


def _int32(value: str) -> int:
    number = int(value)
    if not -2**31 <= number < 2**31:
        raise ValueError(value)
    return number


def sidecar_metadata(content: bytes) -> dict | None:
    """The metadata of one sidecar file; none where no feature is known."""
    about, annotations = None, []
    try:
        for feature in ElementTree.fromstring(content).iterfind(".//feature"):
            get = feature.attrib.get
            if get("name") == "about":
                about = {"authors": get("authors", C.DEFAULT_AUTHORS), "title": get("title", C.DEFAULT_TITLE),
                         "language": get("lang", C.DEFAULT_LANGUAGE)}
            elif get("name") == "plagiarism":
                annotations.append({
                    "source_reference": get("source_reference", C.DEFAULT_REFERENCE),
                    "offset": _int32(get("this_offset", str(C.DEFAULT_OFFSET))),
                    "length": _int32(get("this_length", str(C.DEFAULT_LENGTH))),
                    "type": get("type", C.DEFAULT_TYPE), "obfuscation": get("obfuscation", C.DEFAULT_OBFUSCATION)})
    except (ElementTree.ParseError, ValueError, LookupError):  # malformed, no integer, unknown encoding
        return {"authors": None, "title": None, "language": C.DEFAULT_LANGUAGE, "plagiarism": None}
    if about is None and not annotations:
        return None
    return {**(about or dict.fromkeys(("authors", "title", "language"))), "plagiarism": annotations or None}


def text_of(content: bytes) -> str:
    """UTF-8 with undecodable bytes dropped and universal line ends."""
    return content.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root and the root's path in it."""
    if "://" in root and not root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    path = root.removeprefix("file:")
    return fs.LocalFileSystem(), "/" + path.lstrip("/") if root.startswith("file:") else path


@dataclass
class Part(InputPartition):
    """One folder of one side."""

    side: str
    name: str
    folder: str


class LabelledCorpus(DataSource):
    """Options: ``path`` (the root); ``side`` (``source`` or ``suspicious``, both if left out); ``content`` (``false``
    lists files without opening them); ``bounds`` (JSON: per side the last ``[part, hash, id]`` read)."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        if self.options.get("content", "true") == "false":
            return LISTED
        return f"{LISTED}, raw_text string, metadata {METADATA_TYPE.simpleString()}"

    def reader(self, schema):
        return LabelledReader(dict(self.options))


class LabelledReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.sides = [options["side"]] if "side" in options else list(C.SIDES)
        self.content = options.get("content", "true") != "false"
        self.bounds = json.loads(options.get("bounds", "{}"))
        self.seed = options.get("seed", "42")
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("part",), ("type",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Part]:
        files, root = file_system(self.root)
        found, sides = [], 0
        for side in self.sides:
            base = f"{root}/{C.BASE}/{C.SIDES[side]}"
            if files.get_file_info(base).type != fs.FileType.Directory:
                continue
            sides += 1
            found += [Part(side, f.base_name, f.path) for f in files.get_file_info(fs.FileSelector(base))
                      if f.type == fs.FileType.Directory and f.base_name.startswith("part")]
        if not sides:
            raise FileNotFoundError(f"no side of a labelled corpus under {self.root}")
        wanted = lambda name, value: name not in self.wanted or value in self.wanted[name]
        found = [p for p in found if wanted("type", p.side) and wanted("part", p.name)]
        last = {side: bound[0] for side, bound in self.bounds.items()}
        found = [p for p in found if p.side not in last or p.name <= last[p.side]]
        return sorted(found, key=lambda p: (p.side, p.name)) or [Part("", "", "")]

    def sampled(self, part: Part, doc_id: str) -> bool:
        bound = self.bounds.get(part.side)
        if bound is None or part.name < bound[0]:
            return True
        return [hashlib.md5(f"{self.seed}|{doc_id}".encode()).hexdigest(), doc_id] <= bound[1:]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_WHOLE if self.content else _LISTED)
        if not partition.folder:
            return
        files, _ = file_system(self.root)
        names = {f.base_name: f.path for f in files.get_file_info(fs.FileSelector(partition.folder))
                 if f.type == fs.FileType.File}
        rows, size = [], 0
        for name in sorted(names):
            doc_id = name.removesuffix(".txt")
            if doc_id == name or not self.sampled(partition, doc_id):
                continue
            row = {"path": names[name], "part": partition.name, "id": doc_id, "type": partition.side}
            size += 256
            if self.content:
                row["raw_text"] = text_of(self.bytes_of(files, names[name]))
                sidecar = names.get(f"{doc_id}.xml")
                row["metadata"] = sidecar_metadata(self.bytes_of(files, sidecar)) if sidecar else None
                size += 4 * len(row["raw_text"])
            rows.append(row)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    @staticmethod
    def bytes_of(files: fs.FileSystem, path: str) -> bytes:
        with files.open_input_stream(path, compression=None) as stream:
            return stream.read()


def read_labelled(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """The documents of a labelled corpus with their metadata (see ``LabelledCorpus`` for the options)."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LabelledCorpus)
    return spark.read.format(FORMAT).options(**options).load(root)


def sample_bounds(spark: SparkSession, root: str, sizes: dict[str, int | None], seed: int = 42) -> dict[str, list[str]]:
    """Per side the last ``[part, hash, id]`` of a sample of so many files (see ``corpus.sample_cap``)."""
    bounds = {}
    for side, n in sizes.items():
        if n is None:
            continue
        listing = C.sample_cap(read_labelled(spark, root, side=side, content="false"), n, seed=seed)
        last = listing.agg(F.max(F.struct("part", F.md5(F.concat(F.lit(f"{seed}|"), "id")).alias("hash"), "id"))
                           .alias("last")).first()["last"]
        bounds[side] = list(last) if last else ["", "", ""]
    return bounds
