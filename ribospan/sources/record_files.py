"""Multi-line record files as a Spark data source: one file is read by several tasks.

    spark.dataSource.register(RecordFiles)
    spark.read.format("record_files").option("kind", "triplet").schema("rec_id string, seq string").load(path)

A file is cut into byte ranges. A task seeks to its range, goes on to the next record that starts there,
and reads on to the end of the record that its range ends in, so each record is read once and no task
needs a whole file. Only the columns of the given schema are parsed. Kinds:

* ``triplet``: header, sequence, comma-joined track; ``dataset_id, rec_id, seq, track, label, bad_reason``
* ``profile``: header and five numeric rows; ``dataset_id, rec_id, structure_type, profile``
* ``pwm``: MEME motifs; ``dataset_id, motif, pos, symbol, p``

Options: ``path`` (a file, a folder or a pattern in the last part), ``splitBytes`` (64 MB; with more than
``MOST_RANGES`` of them, smaller ranges grow up to that and a task reads several of small files), ``strict`` (a
malformed record fails the job; else a triplet has a ``bad_reason`` and other records drop out), ``length``
(values in a row of a profile). Files are opened through ``pyarrow.fs``, in the driver to be listed and in
the tasks to be read. A dataset is the folder ``dataset_id=<name>`` or else the stem of the file.
"""

from __future__ import annotations

import fnmatch
import posixpath
import re
import sys
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The reader travels with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 20
MOST_RANGES, GROWN_RANGES = 1024, 256
LARGE_RANGE = 64 << 20
#: What a record begins with, at the beginning of a line.
MARKS = {"triplet": b">", "profile": b">", "pwm": b"MOTIF "}
SCHEMAS = {
    "triplet": "dataset_id string, rec_id string, seq string, track array<double>, label int, bad_reason string",
    "profile": "dataset_id string, rec_id string, structure_type string, profile array<double>",
    "pwm": "dataset_id string, motif string, pos int, symbol string, p double",
}
# Order of the profile rows in a structure block, and of the letters in a matrix row.
PROFILE_ROWS = ("paired", "hairpin", "inner", "multi", "external")
LETTERS = "ACGU"


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed_files(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the data files that ``path`` names, hidden ones left out."""
    from pyarrow import fs

    system, inner = file_system(path)
    head, last = posixpath.split(inner.rstrip("/"))
    pattern = any(c in last for c in "*?[{")
    if pattern:
        found = system.get_file_info(fs.FileSelector(head, recursive=False))
        choices = re.search(r"\{([^}]*)\}", last)
        names = [last[: choices.start()] + x + last[choices.end() :] for x in choices[1].split(",")] if choices else [last]
        found = [f for f in found if any(fnmatch.fnmatchcase(f.base_name, n) for n in names)]
    else:
        one = system.get_file_info(inner)
        if one.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [one] if one.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
    prefix = path[: len(path) - len(inner)] if "://" in path else ""
    good = [f for f in found if f.is_file and not any(part[:1] in "._" and "=" not in part for part in f.path[len(head) :].split("/") if part)]
    return sorted((prefix + f.path, f.size) for f in good)


def dataset_of(path: str, kind: str) -> str:
    folder = re.search(r"/dataset_id=([^/]+)/", path)
    if folder:
        return unquote(folder[1])
    stem = posixpath.basename(path).rsplit(".", 1)[0]
    return re.sub(r"_(pos|neg)$", "", stem) if kind == "triplet" else stem


def split_records(stream, start: int, end: int, mark: bytes):
    """Records that begin in ``[start, end)``: the text after the mark up to the next record.

    A record belongs to the range in which its mark lies. What stands before the first mark of a file
    is no record.
    """
    edge = b"\n" + mark
    if start == 0:
        held, at = b"\n", -1  # a file begins a line
        stream.seek(0)
    else:
        held, at = b"", start - 1
        stream.seek(start - 1)
    begun = None  # where the open record's text begins in ``held``
    look, chunk = 0, min(CHUNK, max(end - start + 1, 1 << 12))  # a short range needs little beyond itself
    while True:
        place = held.find(edge, look)
        if place < 0:
            more = stream.read(chunk)
            if not more:
                if begun is not None:
                    yield held[begun:]
                return
            cut = max(0, len(held) - len(edge)) if begun is None else begun
            held, at = held[cut:] + more, at + cut
            begun = None if begun is None else 0
            look = max(0, len(held) - len(more) - len(edge))
            continue
        if begun is not None:
            yield held[begun:place]
        if at + place + 1 >= end:
            return
        begun = look = place + len(edge)


@dataclass
class Ranges(InputPartition):
    """What one task reads: ``(path, start, end)`` of one range, or of several of small files."""

    parts: list[tuple[str, int, int]]


def _lines(text: str) -> list[str]:
    return [x for x in (line.strip() for line in text.splitlines()) if x]


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


class Fail(ValueError):
    """A record that a strict reader does not take."""


def parse_triplet(text: str, dataset: str, path: str, wanted: set, strict: bool, length: int | None):
    lines = _lines(text)
    seq, track = (lines[k] if len(lines) > k else None for k in (1, 2))
    reason = None
    if len(lines) != 3:
        reason = "line count is not three"
    elif not re.fullmatch("[ACGTUN]+", seq):
        reason = "invalid sequence"
    elif len(seq) != track.count(",") + 1:
        reason = "length mismatch"
    if reason and strict:
        raise Fail(f"{dataset}: {reason} at {lines[0] if lines else ''}")
    row = {"dataset_id": dataset, "rec_id": lines[0] if lines else None, "seq": seq, "bad_reason": reason}
    row["label"] = 1 if re.search(r"_pos\.fa$", path) else 0 if re.search(r"_neg\.fa$", path) else None
    if "track" in wanted:
        row["track"] = None if reason else [_number(x) for x in track.split(",")]
    yield row


def parse_profile(text: str, dataset: str, path: str, wanted: set, strict: bool, length: int | None):
    lines = _lines(text)
    rows = [line.split() for line in lines[1:]]
    if len(lines) != 6 or (length is not None and any(len(r) != length for r in rows)):
        if strict:
            raise Fail(f"{dataset}: not five rows of {length or 'equal'} values at {lines[0] if lines else ''}")
        return
    for name, row in zip(PROFILE_ROWS, rows, strict=True):
        yield {"dataset_id": dataset, "rec_id": lines[0], "structure_type": name, "profile": [_number(x) for x in row] if "profile" in wanted else None}


def parse_pwm(text: str, dataset: str, path: str, wanted: set, strict: bool, length: int | None):
    lines, width = _lines(text), re.search(r"w=\s*(\d+)", text)
    rows = [r for r in ([_number(x) for x in line.split()] for line in lines[1:]) if len(r) == len(LETTERS) and None not in r]
    if width is None or len(rows) < int(width[1]):
        if strict:
            raise Fail(f"{dataset}: no whole matrix in motif {lines[0] if lines else ''}")
        return
    name = lines[0].split()[0]
    for pos, row in enumerate(rows[: int(width[1])]):
        for symbol, p in zip(LETTERS, row, strict=True):
            yield {"dataset_id": dataset, "motif": name, "pos": pos, "symbol": symbol, "p": p}


PARSERS = {"triplet": parse_triplet, "profile": parse_profile, "pwm": parse_pwm}


class RecordReader(DataSourceReader):
    def __init__(self, options: dict, schema) -> None:
        self.kind = options.get("kind", "triplet")
        if self.kind not in PARSERS:
            raise ValueError(f"kind is one of {sorted(PARSERS)}")
        self.path, self.split = options["path"], int(options.get("splitbytes", options.get("splitBytes", 64 << 20)))
        self.strict = str(options.get("strict", "true")).lower() == "true"
        self.length = int(options["length"]) if options.get("length") else None
        self.columns = schema.fieldNames()
        known = {c.split()[0] for c in SCHEMAS[self.kind].split(", ")}
        if not set(self.columns) <= known:
            raise ValueError(f"unknown columns: {sorted(set(self.columns) - known)}")

    def partitions(self) -> list[Ranges]:
        files = listed_files(self.path)
        ranges = [(path, k, min(k + self.split, size)) for path, size in files for k in range(0, size, self.split)]
        step = max(self.split, min(LARGE_RANGE, -(-sum(size for _, size in files) // GROWN_RANGES)))
        if len(ranges) <= MOST_RANGES:
            return [Ranges([part]) for part in ranges]
        out, held = [], 0
        for part in [(path, k, min(k + step, size)) for path, size in files for k in range(0, size, step)]:
            size = part[2] - part[1]
            if not out or held + size > step:
                out.append(Ranges([]))
                held = 0
            out[-1].parts.append(part)
            held += size
        return out

    def read(self, task: Ranges):
        parse, wanted = PARSERS[self.kind], set(self.columns)
        for path, start, end in task.parts:
            system, inner = file_system(path)
            dataset = dataset_of(path, self.kind)
            with system.open_input_file(inner) as stream:
                for record in split_records(stream, start, end, MARKS[self.kind]):
                    for row in parse(record.decode(), dataset, path, wanted, self.strict, self.length):
                        yield tuple(row.get(c) for c in self.columns)


class RecordFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "triplet")]

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options), schema)
