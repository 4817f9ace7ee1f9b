"""HTML extraction by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block is a vector of its
hashed tag path (tags, class, id and role words), hashed words and a few
measures; a bidirectional LSTM in numpy reads the whole sequence both ways and
labels every block as article or not. The article's blocks, in page order, are
the text.

The labeller is trained here, on ``PAGES`` generated pages whose blocks have
known labels (see :mod:`playloom.llm.html_training`); its size is fixed.

Scale: a scan without a shuffle, on Arrow batches; pages are read whole, and
within a batch pages are labelled together, longest first.

Defined results: null html counts as empty and gives empty text; pages without
tags are one block; repeated rows agree; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from playloom.llm.html_leaves import Leaf, leaves
from playloom.llm.words import chunks, hashed_words

PATHS, WORDS, MEASURES = 4096, 512, 7
HIDDEN = 10
PAGES, EPOCHS = 2000, 5

_path_slots: dict[str, int] = {}


def _slot(name: str) -> int:
    slot = _path_slots.get(name)
    if slot is None:
        if len(_path_slots) > 100_000:
            _path_slots.clear()
        slot = _path_slots[name] = zlib.crc32(name.encode()) % PATHS
    return slot


class Inputs:
    """Vectors of the leaf blocks of several pages."""

    def __init__(self, pages: list[list[Leaf]]):
        blocks = [b for page in pages for b in page]
        self.lengths = np.array([len(p) for p in pages], np.int64)
        n = len(blocks)
        paths = [[_slot(name) for name in b.path] or [_slot("<none")] for b in blocks]
        self.path_start = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int64)[:-1] if n else np.empty(0, np.int64)
        self.path = np.array([s for p in paths for s in p], np.int64)
        self.words = np.zeros((n, WORDS), np.float32)
        for begin, data, offsets in chunks(pa.array([b.text for b in blocks], pa.string())):
            hashes, first = hashed_words(data, offsets)
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
            counts = np.bincount(owner * WORDS + (hashes & np.uint64(WORDS - 1)).astype(np.int64), minlength=(len(offsets) - 1) * WORDS)
            counts = counts.reshape(-1, WORDS) / np.maximum(np.diff(first), 1)[:, None]
            self.words[begin : begin + len(counts)] = np.sqrt(counts)
        measures = np.zeros((n, MEASURES), np.float32)
        k = 0
        for page in pages:
            for place, b in enumerate(page):
                size = len(b.text)
                measures[k] = (math.log1p(size) / 6, b.linked / size, sum(map(b.text.count, ".,;")) / size * 10, place / len(page), 1 - (place + 1) / len(page), b.text[-1] in ".!?", size > 120)
                k += 1
        self.measures = measures


class BlockLabeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @classmethod
    def fresh(cls, seed: int = 3) -> BlockLabeller:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        p = {"path": draw(PATHS, 8 * h) * 0.3, "words": draw(WORDS, 8 * h) * 0.3, "measures": draw(MEASURES, 8 * h), "bias": np.zeros(8 * h, np.float32)}
        p |= {"ahead": draw(h, 4 * h), "back": draw(h, 4 * h), "out": draw(2 * h), "out_bias": np.zeros(1, np.float32)}
        p["bias"][h : 2 * h] = p["bias"][5 * h : 6 * h] = 1  # remember at first
        return cls(p)

    def _drive(self, x: Inputs) -> np.ndarray:
        p = self.p
        return np.add.reduceat(p["path"][x.path], x.path_start, axis=0) + x.words @ p["words"] + x.measures @ p["measures"] + p["bias"]

    @staticmethod
    def _places(lengths: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pages longest first; place of step t of page r is first[r] + t (or last[r] - t)."""
        order = np.argsort(-lengths, kind="stable")
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        return order, first + lengths[order] - 1 if backwards else first

    def _run(self, drive: np.ndarray, lengths: np.ndarray, weights: np.ndarray, backwards: bool, keep: list | None = None) -> np.ndarray:
        h = HIDDEN
        order, first = self._places(lengths, backwards)
        sorted_lengths = lengths[order]
        out = np.zeros((len(drive), h), np.float32)
        state, cell = np.zeros((len(lengths), h), np.float32), np.zeros((len(lengths), h), np.float32)
        for t in range(int(sorted_lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(-sorted_lengths, -t, side="left"))  # pages longer than t
            at = first[:n] - t if backwards else first[:n] + t
            z = drive[at] + state[:n] @ weights
            gates = 1 / (1 + np.exp(-z[:, : 3 * h]))
            new = np.tanh(z[:, 3 * h :])
            before = cell[:n].copy()
            cell[:n] = gates[:, h : 2 * h] * before + gates[:, :h] * new
            squashed = np.tanh(cell[:n])
            if keep is not None:
                keep.append((at, n, gates, new, before, squashed, state[:n].copy()))
            state[:n] = gates[:, 2 * h :] * squashed
            out[at] = state[:n]
        return out

    def _unroll(self, keep: list, slope: np.ndarray, drive_slope: np.ndarray, weights: np.ndarray, pages: int) -> np.ndarray:
        """Back through time: fills drive_slope, returns the slope of the recurrent weights."""
        h = HIDDEN
        d_state, d_cell, d_weights = np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32), np.zeros_like(weights)
        for at, n, gates, new, before, squashed, state in reversed(keep):
            enter, forget, leave = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            ds = slope[at] + d_state[:n]
            dc = d_cell[:n] + ds * leave * (1 - squashed**2)
            dz = np.concatenate([dc * new * enter * (1 - enter), dc * before * forget * (1 - forget), ds * squashed * leave * (1 - leave), dc * enter * (1 - new**2)], axis=1)
            drive_slope[at] = dz
            d_weights += state.T @ dz
            d_state[:n], d_cell[:n] = dz @ weights.T, dc * forget
        return d_weights

    def score(self, x: Inputs) -> np.ndarray:
        """Probability of each block to be part of the article."""
        if not len(x.path_start):
            return np.empty(0)
        drive, h = self._drive(x), HIDDEN
        states = np.concatenate([self._run(drive[:, : 4 * h], x.lengths, self.p["ahead"], False), self._run(drive[:, 4 * h :], x.lengths, self.p["back"], True)], axis=1)
        return 1 / (1 + np.exp(-(states @ self.p["out"] + self.p["out_bias"])))

    def slopes(self, x: Inputs, y: np.ndarray) -> dict[str, np.ndarray]:
        p, h, n = self.p, HIDDEN, len(y)
        drive = self._drive(x)
        ahead, back = [], []
        states = np.concatenate([self._run(drive[:, : 4 * h], x.lengths, p["ahead"], False, ahead), self._run(drive[:, 4 * h :], x.lengths, p["back"], True, back)], axis=1)
        error = ((1 / (1 + np.exp(-(states @ p["out"] + p["out_bias"]))) - y) / n).astype(np.float32)
        d_states = error[:, None] * p["out"]
        d_drive = np.zeros_like(drive)
        out = {"out": states.T @ error, "out_bias": error.sum(keepdims=True)}
        out["ahead"] = self._unroll(ahead, d_states[:, :h], d_drive[:, : 4 * h], p["ahead"], len(x.lengths))
        out["back"] = self._unroll(back, d_states[:, h:], d_drive[:, 4 * h :], p["back"], len(x.lengths))
        out["bias"], out["words"], out["measures"] = d_drive.sum(0), x.words.T @ d_drive, x.measures.T @ d_drive
        out["path"] = np.zeros_like(p["path"])
        np.add.at(out["path"], x.path, np.repeat(d_drive, np.diff(np.append(x.path_start, len(x.path))), axis=0))
        return out

    @classmethod
    def fit(cls, pages: list[list[Leaf]], labels: list[list[int]], epochs: int = EPOCHS, together: int = 40, rate: float = 0.02, seed: int = 3) -> BlockLabeller:
        """Adam on the logistic loss of all blocks."""
        model, rng, step = cls.fresh(seed), np.random.default_rng(seed), 0
        batches = []
        for begin in range(0, len(pages), together):
            part = slice(begin, begin + together)
            batches.append((Inputs(pages[part]), np.array([y for page in labels[part] for y in page], np.float32)))
        first, second = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2))
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                step += 1
                for name, g in model.slopes(*batches[k]).items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g * g - second[name])
                    model.p[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7) + 1e-5 * model.p[name]
        return model


_trained: dict[tuple[int, int], BlockLabeller] = {}


def trained(pages: int = PAGES, seed: int = 3) -> BlockLabeller:
    """The labeller, trained once in this process."""
    if (pages, seed) not in _trained:
        from playloom.llm.html_training import labelled_page

        made = [labelled_page(seed * 1_000_003 + k) for k in range(pages)]
        _trained[pages, seed] = BlockLabeller.fit([m[0] for m in made], [m[1] for m in made])
    return _trained[pages, seed]


def texts_of(model: BlockLabeller, sources: list[str]) -> list[str]:
    """The article text of each page."""
    pages = [leaves(s) for s in sources]
    scores = model.score(Inputs(pages))
    out, at = [], 0
    for page in pages:
        out.append(" ".join(b.text for b, s in zip(page, scores[at : at + len(page)]) if s >= 0.5))
        at += len(page)
    return out


def extract(pages: DataFrame, model: BlockLabeller | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                texts = texts_of(model, [s or "" for s in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
