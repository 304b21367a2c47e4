"""Fill-in-the-middle transformation by a table-driven byte automaton.

One automaton over bytes follows UTF-8 sequences, the borders of units and the sentinels at once. Its transitions carry
counts: a code point begins, a unit begins, a sentinel ends. The first pass runs it over whole texts and adds the counts up;
the second runs it again over only those stretches in which a cut or a sentinel lies, to find the place.

The automaton forgets: after a few bytes, whose number is worked out from the table, it is in the same state wherever it
started. So texts are laid into lanes of equal length that start independently, each warmed up on the bytes before it, and
numpy takes one step in all lanes of a batch at a time. The work per byte is the same for short and very long texts.

Defined results: a null text is an empty one and stays plain, with no units; a null id hashes as an empty one; repeated rows
give repeated results, as cuts and forms depend on id and text only; a text that holds a sentinel stays plain; bytes that
are no UTF-8 count as code points of their own where no sequence is open; an empty table gives an empty result; texts of any
length are taken whole; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import small_batches, spread, table

#: Bytes of a lane, and lanes that are stepped through at once.
LANE = 256
LANES = 8192
#: Counts of a lane share one integer: code points, units, sentinels.
FIELD = 20
MASK = (1 << FIELD) - 1
SPACE = b" \t\n\v\f\r"
PLAIN, PSM, SPM = "plain", "psm", "spm"

SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


@dataclass(frozen=True)
class MiddleParams:
    """``unit``: line, word or char; ``rate`` of texts in percent are transformed, ``spm_rate`` of those in the order suffix, prefix, middle."""

    unit: str = "line"
    seed: str = "7"
    rate: int = 100
    spm_rate: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> list[bytes]:
        return [m.encode() for m in (self.prefix, self.suffix, self.middle)]


class ByteAutomaton:
    """States are (open continuation bytes, place in a unit, longest mark that has begun); columns are classes of bytes.

    ``step[state * width + class]`` is the next state times width, ``count`` the packed counts of that transition and
    ``mark`` the number of the mark that it completes, from 1. The last class stands for no byte.
    """

    def __init__(self, unit: str, marks: list[bytes]):
        if unit not in ("line", "word", "char"):
            raise ValueError(f"no such unit: {unit}")
        if any(a in b for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j) or not all(marks):
            raise ValueError("marks must be there and not lie in each other")
        self.unit, self.marks = unit, marks
        begun = {m[:k] for m in marks for k in range(len(m))}
        first = (0, "start", b"")
        number, rows, queue = {first: 0}, [], [first]
        for state in queue:
            row = []
            for byte in range(256):
                after, counts, done = self._move(state, byte, begun)
                if after not in number:
                    number[after] = len(queue)
                    queue.append(after)
                row.append((number[after], counts, done))
            rows.append(row)
        cells = np.array(rows, np.int64)  # state, byte, (next, counts, mark)
        columns, of = np.unique(cells.transpose(1, 0, 2).reshape(256, -1), axis=0, return_inverse=True)
        self.class_of = of.ravel().astype(np.intp)
        self.none = len(columns)
        self.width = width = len(columns) + 1
        states = np.arange(len(queue))
        moves = columns.reshape(len(columns), len(queue), 3)
        self.step = np.concatenate([moves[:, :, 0], states[None]]).T.ravel() * width
        self.count = np.concatenate([moves[:, :, 1], states[None] * 0]).T.ravel()
        self.mark = np.concatenate([moves[:, :, 2], states[None] * 0]).T.ravel()
        self.memory = self._memory(moves[:, :, 0])

    def _move(self, state, byte, begun):
        open_bytes, place, seen = state
        inside = open_bytes > 0 and 0x80 <= byte < 0xC0
        if inside:
            left, starts = open_bytes - 1, False
        else:
            left, starts = (3 if byte >= 0xF0 else 2 if byte >= 0xE0 else 1 if byte >= 0xC0 else 0), True
        blank = byte in SPACE
        if self.unit == "line":
            unit, place = starts and place == "start", "start" if byte == 10 else "in"
        elif self.unit == "word":
            unit, place = starts and (place == "start" or (place == "gap" and not blank)), "gap" if blank else "in"
        else:
            unit, place = starts, "in"
        seen += bytes([byte])
        done = next((k for k, m in enumerate(self.marks, 1) if seen.endswith(m)), 0)
        seen = next(seen[k:] for k in range(len(seen) + 1) if seen[k:] in begun)
        return (left, place, seen), starts | unit << FIELD | (done > 0) << 2 * FIELD, done

    @staticmethod
    def _memory(moves: np.ndarray) -> int:
        """The number of bytes after which every state has become the same."""
        sets, n = {frozenset(range(moves.shape[1]))}, 0
        while any(len(s) > 1 for s in sets):
            sets, n = {frozenset(row[list(s)].tolist()) for s in sets for row in moves if len(s) > 1}, n + 1
            if n > 64:
                raise ValueError("the automaton does not forget")
        return n

    def lanes(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text, first byte and number of bytes of each lane; a text without bytes has one lane."""
        n = np.maximum(-(-(end - begin) // LANE), 1)
        of = np.repeat(np.arange(len(begin)), n)
        start = begin[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * LANE
        return of, start, np.minimum(end[of] - start, LANE)

    def _classes(self, data: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int) -> np.ndarray:
        """Classes of the bytes from ``start`` on, step by lane; none outside ``low`` to ``high``."""
        at = start[None, :] + np.arange(steps)[:, None]
        out = self.class_of[data[np.clip(at, 0, max(len(data) - 1, 0))]] if len(data) else np.full(at.shape, self.none)
        out[(at < low) | (at >= high)] = self.none
        return out

    def run(self, data: np.ndarray, begin: np.ndarray, start: np.ndarray, size: np.ndarray, trace: bool = False):
        """Counts of each lane; with ``trace`` the counts and marks of each step, step by lane. ``begin``: where the lane's text begins."""
        totals, counts, marks = [], [], []
        for k in range(0, len(start), LANES):
            s, b, n = start[k : k + LANES], begin[k : k + LANES], size[k : k + LANES]
            state = np.zeros(len(s), np.int64)
            for column in self._classes(data, s - self.memory, b, s, self.memory):
                state = self.step[state + column]
            total = np.zeros(len(s), np.int64)
            for column in self._classes(data, s, s, s + n, int(n.max(initial=0))):
                state += column
                if trace:
                    counts.append(self.count[state])
                    marks.append(self.mark[state])
                else:
                    total += self.count[state]
                state = self.step[state]
            totals.append(total)
        if trace:  # a trace is taken of fewer than LANES lanes
            return np.array(counts).reshape(-1, len(start)), np.array(marks).reshape(-1, len(start))
        return np.concatenate(totals) if totals else np.zeros(0, np.int64)


class Scan:
    """The counts of many texts that lie one behind the other in ``data``."""

    def __init__(self, automaton: ByteAutomaton, data: np.ndarray, offsets: np.ndarray):
        self.automaton, self.data = automaton, data
        self.begin, self.end = offsets[:-1], offsets[1:]
        self.of, self.start, self.size = automaton.lanes(self.begin, self.end)
        got = automaton.run(data, self.begin[self.of], self.start, self.size)
        self.lane_chars, self.lane_units, self.lane_marks = got & MASK, got >> FIELD & MASK, got >> 2 * FIELD
        self.first_lane = np.searchsorted(self.of, np.arange(len(self.begin)))
        self.units, self.marks = (np.bincount(self.of, x, len(self.begin)).astype(np.int64) for x in (self.lane_units, self.lane_marks))

    def _traced(self, lanes: np.ndarray):
        return self.automaton.run(self.data, self.begin[self.of[lanes]], self.start[lanes], self.size[lanes], True)

    def cuts(self, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte place and number of code points before the end of the first ``after`` units of each text."""
        up_units = np.concatenate([[0], np.cumsum(self.lane_units)])
        up_chars = np.concatenate([[0], np.cumsum(self.lane_chars)])
        last = np.append(self.first_lane[1:], len(self.of))
        place, chars = self.end.copy(), up_chars[last] - up_chars[self.first_lane]
        inner = np.flatnonzero(after < self.units)
        for k in range(0, len(inner), LANES // 2):
            t = inner[k : k + LANES // 2]
            goal = up_units[self.first_lane[t]] + after[t]  # units that begin before the one which begins at the cut
            lane = np.searchsorted(up_units, goal, "right") - 1
            counts, _ = self._traced(lane)
            begun = np.cumsum(counts >> FIELD & MASK, axis=0)
            at = np.argmax(begun > (goal - up_units[lane])[None, :], axis=0)
            place[t] = self.start[lane] + at
            before = np.cumsum(counts & MASK, axis=0)[at, np.arange(len(t))] - 1
            chars[t] = up_chars[lane] - up_chars[self.first_lane[t]] + before
        return place, chars

    def marked(self) -> list[list[tuple[int, int]]]:
        """For each text the (mark from 0, byte place behind it) of all marks, in order."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.begin]
        hold = np.flatnonzero(self.lane_marks)
        for k in range(0, len(hold), LANES // 2):
            lane = hold[k : k + LANES // 2]
            _, marks = self._traced(lane)
            which, step = np.nonzero(marks.T)
            for w, s in zip(which.tolist(), step.tolist(), strict=True):
                out[self.of[lane[w]]].append((int(marks[s, w]) - 1, int(self.start[lane[w]]) + s + 1))
        return out


_automata: dict[tuple, ByteAutomaton] = {}


def automaton(params: MiddleParams) -> ByteAutomaton:
    """One automaton a worker and kind."""
    key = (params.unit, *params.marks)
    if key not in _automata:
        _automata[key] = ByteAutomaton(params.unit, params.marks)
    return _automata[key]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow column, null as empty, and their offsets."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def draws(doc_id: int | None, seed: str) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the hex sha256 of seed and id."""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(hexed[k : k + 8], 16) for k in range(0, 32, 8))


def transformed(docs: DataFrame, params: MiddleParams = MiddleParams()) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and the output text of every row of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = automaton(params)
        p, s, m = params.marks
        for b in batches:
            ids = b.column(0).cast(pa.int64()).to_pylist()
            data, offsets = texts_of(b.column(1))
            scan = Scan(table_of, data, offsets)
            h = np.array([draws(i, params.seed) for i in ids], np.int64).reshape(-1, 4)
            picks = np.sort(h[:, :2] % (scan.units[:, None] + 1), axis=1)
            (one, one_chars), (two, two_chars) = scan.cuts(picks[:, 0]), scan.cuts(picks[:, 1])
            plain = (offsets[1:] == offsets[:-1]) | (scan.marks > 0) | (h[:, 2] % 100 >= params.rate)
            spm = h[:, 3] % 100 < params.spm_rate
            whole, outputs, forms = data.tobytes(), [], []
            for k, (a, z) in enumerate(pairwise(offsets.tolist())):
                if plain[k]:
                    outputs.append(whole[a:z])
                    forms.append(PLAIN)
                    continue
                head, mid, tail = whole[a : one[k]], whole[one[k] : two[k]], whole[two[k] : z]
                outputs.append(b"".join([s, tail, p, head, m, mid] if spm[k] else [p, head, s, tail, m, mid]))
                forms.append(SPM if spm[k] else PSM)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(scan.units, pa.int64()), pa.array(forms, pa.string()),
                 pa.array(one_chars, pa.int64(), mask=plain), pa.array(two_chars - one_chars, pa.int64(), mask=plain), pa.array(outputs, pa.binary()).view(pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    small_batches(docs.sparkSession)
    return spread(docs.select("doc_id", "text")).mapInArrow(run, SCHEMA)


def restored(made: DataFrame, params: MiddleParams = MiddleParams()) -> DataFrame:
    """``made`` with the text rebuilt from form and output as column ``restored``; null if the output does not have the form's marks."""
    names = made.columns
    if "restored" in names:
        raise ValueError("a column is called restored already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = automaton(params)
        p, s, m = (len(x) for x in params.marks)
        for b in batches:
            data, offsets = texts_of(b.column(names.index("output")))
            whole, found, texts = data.tobytes(), Scan(table_of, data, offsets).marked(), []
            for form, marks, (a, z) in zip(b.column(names.index("form")).to_pylist(), found, pairwise(offsets.tolist()), strict=True):
                order = [k for k, _ in marks]
                if form == PLAIN:
                    texts.append(whole[a:z])
                elif form == PSM and order == [0, 1, 2]:
                    (_, x), (_, y), (_, w) = marks
                    texts.append(whole[x : y - s] + whole[w:z] + whole[y : w - m])
                elif form == SPM and order == [1, 0, 2]:
                    (_, x), (_, y), (_, w) = marks
                    texts.append(whole[y : w - m] + whole[w:z] + whole[x : y - p])
                else:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary()).view(pa.string())], names=[*names, "restored"])

    small_batches(made.sparkSession)
    return made.mapInArrow(run, StructType([*made.schema.fields, StructField("restored", StringType())]))


def op12_middle_cuts(spark, sf_dir: str) -> DataFrame:
    """Every document cut into lines and transformed, with digests of the output and of the text rebuilt from it."""
    made = restored(transformed(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL_OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ps, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, CASE WHEN t = '' THEN 0 ELSE len(ps) - CAST(ends_with(t, chr(10)) AS BIGINT) END AS n,
             CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
p AS (SELECT *, CASE WHEN a >= len(ps) THEN t WHEN a = 0 THEN '' ELSE array_to_string(ps[1:a], chr(10)) || chr(10) END AS to_a,
             CASE WHEN b >= len(ps) THEN t WHEN b = 0 THEN '' ELSE array_to_string(ps[1:b], chr(10)) || chr(10) END AS to_b FROM c),
f AS (SELECT *, to_a AS pre, substr(to_b, length(to_a) + 1) AS mid, substr(t, length(to_b) + 1) AS suf,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM p)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
