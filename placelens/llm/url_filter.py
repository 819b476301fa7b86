"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one row of 64-bit words.  Each character (code
point) of a canonical URL, host and path, moves all rules at once: a shift, a
mask of the states that the character enters, and a mask of the wildcards that
stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices


#: Steps of a pattern besides plain characters: any one character, any characters, any but a slash.
ONE, ANY, HOST = -1, -2, -3
#: Bytes of state that a task holds for a slice of URLs.
STATE_BYTES = 1 << 22
#: Rules that a table may hold; they go to every task.
MOST_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    """``host/path``, read literally: fits the host and its subdomains where the path starts with the rule's."""

    verdict: str
    text: str

    @property
    def pattern(self) -> list[int]:
        return [HOST, *map(ord, f".{self.text}"), ANY]  # the URL is written with a dot before its host


def glob(text: str) -> list[int]:
    """The steps of a glob: ``*`` any characters, ``^*`` any but a slash, ``?`` one character."""
    wild = {"^*": HOST, "*": ANY, "?": ONE}
    return [wild[x] if x in wild else ord(x) for x in re.findall(r"\^\*|.", text, re.DOTALL)]


def rules_of(table: DataFrame, most: int = MOST_RULES) -> list[Rule]:
    """The rules of a table (verdict, text) in any order; a table of more than ``most`` rows is an error."""
    rows = table.select("verdict", "text").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return [Rule(*x) for x in rows]


#: Globs over ``.host/path`` that the method blocks where no rule fits: ``*`` any characters, ``^*`` any but a slash, ``?`` one.
BLOCKED = ("^*spam^*/*", "^*cheap-pills^*/*", "^*casino^*/*", "^*porn^*/*", "*/adserver/*", "*/wp-login.php*")


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, path = rest[:end], rest[end:]
    end = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return host.encode().lower().decode(), path[:end]


class Automaton:
    """Shift-And over several words for patterns; a character that no pattern names is of a class of its own."""

    def __init__(self, patterns: list[list[int]]):
        enter: list[int] = []  # what leads into a state
        stay: list[int] = []  # what it stays on
        first, last = [], []
        for pattern in patterns:
            first.append(len(enter))
            enter.append(0)
            stay.append(0)
            for x in pattern:
                if x in (ANY, HOST):
                    stay[-1] = ANY if ANY in (x, stay[-1]) else HOST
                else:
                    enter.append(x)
                    stay.append(0)
            last.append(len(enter) - 1)
        self.words = -(-max(1, len(enter)) // 64)
        self.last = np.array(last, np.int64)
        into, held, start = np.array(enter, np.int64), np.array(stay, np.int64), np.zeros(len(enter), bool)
        start[first] = True
        self.letters = np.union1d(into[(into > 0) & ~start], [0x2F])
        one, inside = self._mask((into == ONE) & ~start), self._mask(held < 0)
        #: By class of character, the last one for all others: states that it enters, and states that it leaves as they are.
        self.enter, self.stay = (np.tile(x, (len(self.letters) + 1, 1)) for x in (one, inside))
        named = np.flatnonzero((into > 0) & ~start)
        np.bitwise_or.at(self.enter, (np.searchsorted(self.letters, into[named]), named // 64), np.uint64(1) << (named % 64).astype(np.uint64))
        self.stay[np.searchsorted(self.letters, 0x2F)] = self._mask(held == ANY)
        self.first = self._mask(start)

    def _mask(self, states: np.ndarray) -> np.ndarray:
        bits = np.zeros(self.words * 64, bool)
        bits[: len(states)] = states
        return np.packbits(bits, bitorder="little").view("<u8").astype(np.uint64)

    def parts(self, strings: list[str]) -> Iterator[np.ndarray]:
        """For each string and pattern, whether the pattern fits the whole string; rows in order, by as many strings as ``STATE_BYTES`` hold."""
        step = max(1, STATE_BYTES // (8 * self.words))
        for i in range(0, len(strings), step):
            yield self._run(strings[i : i + step])

    def _run(self, strings: list[str]) -> np.ndarray:
        sizes = np.array([len(x) for x in strings])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        state = np.tile(self.first, (len(strings), 1))
        data = np.frombuffer("".join(strings[i] for i in order).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        place = np.minimum(np.searchsorted(self.letters, data), len(self.letters) - 1)
        kind = np.where(self.letters[place] == data, place, len(self.letters))
        starts = np.cumsum(sizes) - sizes
        live = len(strings)
        for at in range(int(sizes.max(initial=0))):
            while sizes[live - 1] <= at:
                live -= 1
            own, c = state[:live], kind[starts[:live] + at]
            moved = own << np.uint64(1)
            moved[:, 1:] |= own[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.enter[c]) | (own & self.stay[c])
        out = np.zeros((len(strings), len(self.last)), bool)
        out[order] = (state[:, self.last // 64] >> (self.last % 64).astype(np.uint64)) & np.uint64(1)
        return out


def judge_urls(pages: DataFrame, rules: list[Rule], blocked: tuple[str, ...] = BLOCKED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule, verdict, blocked_by of each row.

    rule is the longest rule that fits (of equally long ones a block, then the
    smallest text), else null; verdict is the rule's, else block if a glob of
    ``blocked`` fits, else allow.  A null URL, or one without ``://``, has an
    empty host and path, fits no rule and is allowed.  One row for each row,
    repeated ones too; an empty table gives an empty one.  No shuffle; other
    columns are ignored, whatever their names.  The state that a task holds is
    bounded by ``STATE_BYTES``, and what fits of it by a few times that, however
    many rules there are, but for the one row that a URL needs.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    automaton = Automaton([r.pattern for r in ordered] + [glob(x) for x in blocked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "url"):
                pairs = [canonical(x) for x in part.column("url").to_pylist()]
                out = []
                for (host, path), fit in zip(pairs, chain.from_iterable(automaton.parts([f".{host}{path}" for host, path in pairs]))):
                    hits = np.flatnonzero(fit)
                    rule = ordered[hits[0]] if len(hits) and hits[0] < len(ordered) else None
                    by = next((blocked[h - len(ordered)] for h in hits if h >= len(ordered)), None)
                    out.append((host, path, rule and rule.text, rule.verdict if rule else "block" if by else "allow", by))
                columns = [pa.array(x, pa.string()) for x in zip(*out)] if out else [pa.array([], pa.string())] * 5
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], ["id", "host", "path", "rule", "verdict", "blocked_by"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string, blocked_by string").withColumnRenamed("id", id_col)
