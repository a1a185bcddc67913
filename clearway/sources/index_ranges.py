"""Frame entries of huge JSON index files, read in byte ranges.

A range that starts in the middle of an object cannot know by itself whether it starts inside a string, how deep, and under which
keys. So every range is first summed up for both cases (inside a string or not); from these sums, one small row per range, the true
state at its start follows. A second reading finds the last root and scene key of each range, a third one the frames with the keys
carried over. Each reading is a job over all ranges; between them only the small rows are shuffled. A scene is never one value,
and an object that crosses the end of its range is read to its end by the task in whose range its key ends.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clearway.sources.storage import many_tasks, open_store

RANGE_BYTES = 8 << 20
# Bytes read at once when a key or a value lies beyond the range.
STEP_BYTES = 1 << 16
# Depth at which each kind of key stands in a document.
ROOT, SCENE, FRAME = 1, 2, 3
QUOTE, BACKSLASH, COLON = ord('"'), ord("\\"), ord(":")
OPENING, CLOSING = [ord("{"), ord("[")], [ord("}"), ord("]")]


class Marks:
    """Quotes and structural bytes of a stretch of JSON, given the state at its start."""

    def __init__(self, data: bytes, escaped: bool, inside: bool = False, depth: int = 0):
        content = np.frombuffer(data, dtype=np.uint8)
        quotes = content == QUOTE
        slashes = np.flatnonzero(content == BACKSLASH)
        if len(slashes) or escaped:
            # A quote is escaped behind an odd run of backslashes; a run may begin before the stretch.
            begins = slashes[np.diff(slashes, prepend=-2) != 1]
            at = np.flatnonzero(quotes)
            behind = at[(at > 0) & (content[at - 1] == BACKSLASH)]
            first = begins[np.searchsorted(begins, behind, side="right") - 1] if len(behind) else behind
            odd = (behind - first + np.where(first == 0, int(escaped), 0)) % 2 == 1
            quotes[behind[odd]] = False
            if escaped and len(content) and content[0] == QUOTE:
                quotes[0] = False
        openings, closings = np.isin(content, OPENING), np.isin(content, CLOSING)
        self.at = np.flatnonzero(quotes | openings | closings | (content == COLON))
        self.kind = content[self.at]
        quote = quotes[self.at]
        self.quotes = int(quote.sum())
        within = (np.cumsum(quote) - quote + int(inside)) % 2 == 1
        self.steps = np.where(quote, 0, openings[self.at].astype(np.int64) - closings[self.at])
        self.outside = ~within & ~quote
        self.depth = depth + np.cumsum(np.where(self.outside, self.steps, 0))
        self.quote_at = self.at[quote]
        self.within = within

    def colons(self, depth: int) -> np.ndarray:
        """Positions of the colons behind keys at a depth."""
        return self.at[self.outside & (self.kind == COLON) & (self.depth == depth)]

    def ends(self, depth: int) -> np.ndarray:
        """Positions at which an object or array closes and the depth is this again."""
        return self.at[self.outside & (self.steps < 0) & (self.depth == depth)]


class Stretch:
    """A range of an open file, which may look beyond both of its ends."""

    def __init__(self, source: pa.NativeFile, start: int, end: int, length: int):
        self.source, self.start, self.length = source, start, length
        self.data = self.between(start, end)
        run, at = 0, start
        while at > 0:
            before = self.between(max(0, at - STEP_BYTES), at)
            rest = before.rstrip(b"\\")
            run += len(before) - len(rest)
            at -= len(before)
            if rest:
                break
        self.escaped = run % 2 == 1

    def between(self, start: int, end: int) -> bytes:
        self.source.seek(start)
        return self.source.read(end - start)

    def key_before(self, colon: int) -> str:
        """The key whose colon is at this position of the range; it may begin before the range."""
        head, step = b"", STEP_BYTES
        low = self.start
        text = self.data[:colon] if colon < step else self.data[colon - step:colon]
        whole = colon < step
        while True:
            text = head + text
            marks_at = _unescaped_quotes(text)
            if len(marks_at) >= 2 and (text[:marks_at[-2]].rstrip(b"\\") or (whole and low == 0)):
                # The opening quote is certain if what stands before it, and before any backslashes there, is seen.
                return json.loads(text[marks_at[-2]:marks_at[-1] + 1])
            if whole and low == 0:
                raise ValueError(f"no key before byte {self.start + colon}")
            if not whole:
                text, head, whole = self.data[:colon], b"", True
                continue
            head = self.between(max(0, low - step), low)
            low -= len(head)
            step *= 2

    def value_after(self, colon: int, end: int | None) -> str:
        """The object behind a colon, up to the known position of its end or as far as it goes; ``null`` if it is no object."""
        at = colon + 1
        text = self.data[at:] if end is None else self.data[at:end + 1]
        reach, step = self.start + len(self.data), STEP_BYTES
        while not text.strip() and reach < self.length:
            more = self.between(reach, min(self.length, reach + step))
            text, reach = text + more, reach + len(more)
        text = text.lstrip()
        if not text.startswith(b"{"):
            return "null"
        while end is None:
            closed = Marks(text, False).ends(0)
            if len(closed):
                text = text[:closed[0] + 1]
                break
            if reach >= self.length:
                raise ValueError(f"the object behind byte {self.start + colon} does not end")
            more = self.between(reach, min(self.length, reach + step))
            text, reach, step = text + more, reach + len(more), step * 2
        return text.decode("utf-8")


def _unescaped_quotes(text: bytes) -> list[int]:
    """Positions of the last two quotes of a text that ends behind a key, by the parity of the backslashes before them."""
    found: list[int] = []
    at = len(text)
    while len(found) < 2 and (at := text.rfind(b'"', 0, at)) >= 0:
        run = at - len(text[:at].rstrip(b"\\"))
        if run % 2 == 0:
            found.append(at)
    return found[::-1]


def _each_range(ranges: DataFrame, schema: str, read: Callable[[Stretch, dict], dict[str, list]]) -> DataFrame:
    """Open every range in a task of its own share and return the rows found in it, next to the range's file and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = open_store(row["file"])
                with store.open_input_file(path) as source:
                    found = read(Stretch(source, row["start"], row["end"], row["length"]), row)
                n = len(next(iter(found.values())))
                keys = {"file": [row["file"]] * n, "start": [row["start"]] * n}
                yield pa.RecordBatch.from_pydict(keys | found, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = f"file STRING, start LONG, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(full))
    # One row is a range of megabytes, so adaptive execution must not put many into a task.
    return ranges.repartition(many_tasks(ranges.sparkSession), "file", "start").mapInArrow(run, full)


def _sums(stretch: Stretch, row: dict) -> dict[str, list]:
    out, into = (Marks(stretch.data, stretch.escaped, inside) for inside in (False, True))
    return {"quotes": [out.quotes], "out": [int(out.depth[-1]) if len(out.at) else 0], "into": [int(into.depth[-1]) if len(into.at) else 0]}


def _last_keys(stretch: Stretch, row: dict) -> dict[str, list]:
    marks = Marks(stretch.data, stretch.escaped, row["inside"], row["depth"])
    last = {n: marks.colons(d)[-1:] for n, d in (("root", ROOT), ("scene", SCENE))}
    return {n: [stretch.key_before(int(at[0])) if len(at) else None] for n, at in last.items()}


def _frames(stretch: Stretch, row: dict) -> dict[str, list]:
    marks = Marks(stretch.data, stretch.escaped, row["inside"], row["depth"])
    roots, scenes, colons, ends = marks.colons(ROOT), marks.colons(SCENE), marks.colons(FRAME), marks.ends(FRAME)
    names = [row["root"], *(stretch.key_before(int(c)) for c in roots)]
    owners = [row["scene"], *(stretch.key_before(int(c)) for c in scenes)]
    found: dict[str, list] = {"scene": [], "at": [], "token": [], "entry": []}
    closes = np.searchsorted(ends, colons, side="right")
    following = [*colons[1:], None]
    for colon, root, owner, close, then in zip(
        colons, np.searchsorted(roots, colons), np.searchsorted(scenes, colons), closes, following
    ):
        if names[root] != "scene_infos":
            continue
        end = int(ends[close]) if close < len(ends) else None
        if then is not None and (end is None or end > then):
            # No object ends before the next key: a plain value.
            end = int(colon)
        found["scene"].append(owners[owner])
        found["at"].append(row["start"] + int(colon))
        found["token"].append(stretch.key_before(int(colon)))
        found["entry"].append(stretch.value_after(int(colon), end))
    return found


def byte_ranges(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """The ranges of one or many files: (file, length, start, end)."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    return files.select("file", "length", starts.alias("start")).withColumn("end", F.least("length", F.col("start") + size))


def frame_entries(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """Every frame entry below ``scene_infos``: (file, at, scene, token, entry), ``entry`` being its JSON text.

    ``at`` is the byte behind the frame's key, so it gives the order in the file. Files may hold any number of documents
    one after another. An entry that is no object comes as ``null``.
    """
    ranges = byte_ranges(spark, path, size)
    # One row per range is windowed, never their content.
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sums = _each_range(ranges, "quotes LONG, `out` LONG, `into` LONG", _sums)
    inside = (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside")
    states = sums.select("file", "start", "out", "into", inside)
    states = states.withColumn("step", F.when(F.col("inside"), F.col("into")).otherwise(F.col("out")))
    states = states.withColumn("depth", F.coalesce(F.sum("step").over(before), F.lit(0))).select("file", "start", "inside", "depth")
    known = ranges.join(states, ["file", "start"])
    keys = _each_range(known, "root STRING, scene STRING", _last_keys)
    carried = keys.select("file", "start", *[F.last(c, ignorenulls=True).over(before).alias(c) for c in ("root", "scene")])
    return _each_range(known.join(carried, ["file", "start"]), "scene STRING, at LONG, token STRING, entry STRING", _frames).drop("start")
