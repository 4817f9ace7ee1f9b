"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into the bits of several 64-bit words, one bit per
state. Each byte of a canonical URL (host and path) moves all states of all
rules at once: shift, mask by the byte, keep the states that loop. Within a
task the step runs on whole Arrow batches with numpy, one column of bytes after
the other. A scan, no shuffle; the packed rules go with the task and their size
depends on the rule list only.

Globs: ``**`` any bytes, ``*`` any bytes but ``/``, ``?`` one byte but ``/``,
``\\`` quotes the next character. A rule (host, path) is the two globs
``host path **`` and ``**. host path **`` whose leading part has no ``/``.

Defined results: a null url or one without ``://`` has empty host and path and
matches no rule; without a rule the default globs block, otherwise it is
allowed; repeated rows give repeated results; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict) of the production list: host and path.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: What the method itself blocks where no rule fits; the rest is allowed.
BLOCK_GLOBS = ("ads.**", "**/ads/**", "**/adserver/**", "**/banners/**")


def host(url: Column) -> Column:
    after = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def quoted(literal: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in literal)


def rule_globs(rule: str) -> tuple[str, str]:
    return quoted(rule) + "**", "*." + quoted(rule) + "**"


class GlobAutomaton:
    """All globs in one automaton. State k of a glob: its first k symbols are read."""

    def __init__(self, globs: list[str]):
        symbols = [self._symbols(g) for g in globs]
        starts = np.cumsum([0] + [1 + sum(s not in ("*", "**") for s in glob) for glob in symbols])
        self.words = max(1, -(-int(starts[-1]) // 64))
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.begin = np.zeros(self.words, np.uint64)
        self.accept = []
        slash = ord("/")
        for glob, first in zip(symbols, starts[:-1]):
            state = int(first)
            self._set(self.begin, state)
            for s in glob:
                if s == "**":
                    self._set(self.stay, state)
                elif s == "*":
                    kept = self._has(self.stay[slash], state)
                    self._set(self.stay, state)
                    if not kept:
                        self._unset(self.stay[slash], state)
                else:
                    state += 1
                    if s == "?":
                        self._set(self.enter, state)
                        self._unset(self.enter[slash], state)
                    else:
                        self._set(self.enter[s], state)
            self.accept.append(state)

    @staticmethod
    def _symbols(glob: str) -> list:
        out, k = [], 0
        while k < len(glob):
            if glob.startswith("**", k):
                out.append("**")
                k += 1
            elif glob[k] in "*?":
                out.append(glob[k])
            else:
                k += glob[k] == "\\" and k + 1 < len(glob)
                out.extend(glob[k].encode())
            k += 1
        return out

    @staticmethod
    def _set(words: np.ndarray, state: int) -> None:
        words[..., state // 64] |= np.uint64(1 << state % 64)

    @staticmethod
    def _unset(words: np.ndarray, state: int) -> None:
        words[..., state // 64] &= ~np.uint64(1 << state % 64)

    @staticmethod
    def _has(words: np.ndarray, state: int) -> bool:
        return bool(int(words[state // 64]) >> state % 64 & 1)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """Boolean matrix: text by glob. Texts run longest first, so those still being read are a prefix."""
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        at = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        data = np.frombuffer(b"".join(texts), np.uint8)
        states = np.tile(self.begin, (len(texts), 1))
        reading = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")
        for k, n in enumerate(reading):
            byte = data[at[:n] + k]
            now = states[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            states[:n] = moved & self.enter[byte] | now & self.stay[byte]
        out = np.empty((len(texts), len(self.accept)), bool)
        for g, state in enumerate(self.accept):
            out[order, g] = states[:, state // 64] >> np.uint64(state % 64) & np.uint64(1)
        return out


def judge(pages: DataFrame, rules: tuple = RULES, block_globs: tuple = BLOCK_GLOBS, url: str = "url", key: str = "page_id", batch: int = 4096) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    ranked = sorted(rules, key=lambda r: -len(r[0]))
    globs = [g for r, _ in ranked for g in rule_globs(r)] + list(block_globs)
    key_type = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = GlobAutomaton(globs)
        names = np.array([r for r, _ in ranked] + [None], object)
        verdicts = np.array([v for _, v in ranked] + [None], object)
        for whole in batches:
            for begin in range(0, whole.num_rows, batch):
                part = whole.slice(begin, batch)
                hosts, paths = part.column(1).to_pylist(), part.column(2).to_pylist()
                hit = automaton.match([(h + p).encode() for h, p in zip(hosts, paths)])
                fits = np.zeros((len(hosts), len(ranked) + 1), bool)
                fits[:, :-1] = hit[:, 0 : 2 * len(ranked) : 2] | hit[:, 1 : 2 * len(ranked) : 2]
                fits[:, -1] = True
                rule = fits.argmax(1)  # the longest comes first
                other = np.where(hit[:, 2 * len(ranked) :].any(1), "block", "allow").astype(object)
                verdict = np.where(rule == len(ranked), other, verdicts[rule])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(names[rule].tolist(), pa.string()), pa.array(verdict.tolist(), pa.string())],
                    names=[key, "host", "path", "rule", "verdict"],
                )

    canonical = pages.select(key, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    return canonical.mapInArrow(run, f"`{key}` {key_type}, host string, path string, rule string, verdict string")
