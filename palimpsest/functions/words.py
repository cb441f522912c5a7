"""The lexical tokens of `text.bm25_tokens` in Python, for tasks that hold a range of documents and count their words in place."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RUN, _PART, _BORDER = re.compile(r"[a-z0-9_./:-]+"), re.compile(r"[a-z0-9_]+"), re.compile(r"[./:-]")


def stem(t: str) -> str:
    n = len(t)
    if n > 5 and t.endswith("ing"):
        return t[:-3]
    if n > 4 and t.endswith("ed"):
        return t[:-2]
    if n > 4 and t.endswith("ies"):
        return t[:-3] + "y"
    if n > 4 and t.endswith("es"):
        return t[:-2]
    return t[:-1] if n > 3 and t.endswith("s") else t


def term_counts(text: str | None) -> dict[str, int]:
    """How often a text has each stemmed token."""
    out: dict[str, int] = {}
    for run, n in Counter(_RUN.findall((text or "").lower())).items():
        for t in [run, *_PART.findall(run)] if _BORDER.search(run) else [run]:
            t = stem(t)
            out[t] = out.get(t, 0) + n
    return out


_KEPT = bytes(i if i < 128 and _RUN.match(chr(i)) else 32 for i in range(256))  # all but the bytes of runs become blanks


def _runs(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(different runs, numbers of the runs of all texts one after the other, how many each text has)."""
    plain = pa.array([(t or "").lower().encode("utf-8", "surrogatepass").translate(_KEPT).strip() for t in texts], pa.binary()).cast(pa.string())
    listed = pc.ascii_split_whitespace(plain)
    size, some = listed.value_lengths().to_numpy(zero_copy_only=False), pc.binary_length(plain).to_numpy(zero_copy_only=False) > 0
    words = listed.flatten()
    if not some.all():  # a text without runs is one empty run
        words = words.filter(pa.array(np.repeat(some, size)))
    found = words.dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.where(some, size, 0)


def _stems(terms: pa.Array) -> tuple[list[str], np.ndarray]:
    """(different stems, number of the stem of each term), as `stem` has them."""
    n = pc.binary_length(terms).to_numpy(zero_copy_only=False)
    ends = lambda x: pc.ends_with(terms, x).to_numpy(zero_copy_only=False)
    kind = np.select([(n > 5) & ends("ing"), (n > 4) & ends("ed"), (n > 4) & ends("ies"), (n > 4) & ends("es"), (n > 3) & ends("s")], [1, 2, 3, 4, 5], 0)
    order = [np.flatnonzero(kind == k) for k in range(6)]
    parts = [pc.utf8_slice_codeunits(x, 0, -cut) if cut else x for cut, x in zip((0, 3, 2, 3, 2, 1), (terms.take(pa.array(i)) for i in order))]
    parts[3] = pc.binary_join_element_wise(parts[3], "y", "")
    found = pa.concat_arrays(parts).dictionary_encode()
    number = np.zeros(len(terms), np.int64)
    number[np.concatenate(order)] = found.indices.to_numpy(zero_copy_only=False)
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), number  # to_pylist takes many times as long


def invert(texts: list[str | None]) -> tuple[dict[str, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each term, at, places, counts, lengths) of some texts: term i is in the texts places[at[i] : at[i + 1]], so often.

    Each different run is split and stemmed once; what the texts have of it is a sum over numbers.
    """
    runs, at, n = _runs(texts)
    border = np.flatnonzero(pc.match_substring_regex(runs, "[./:-]").to_numpy(zero_copy_only=False))
    parts = [_PART.findall(r) for r in runs.take(pa.array(border)).to_numpy(zero_copy_only=False)]
    size, m = np.ones(len(runs), np.int64), max(1, len(texts))
    size[border] += np.array([len(x) for x in parts], np.int64)
    names, stems = _stems(pa.concat_arrays([runs, pa.array([t for x in parts for t in x], pa.string())]))
    begin, own = np.cumsum(size) - size, np.zeros(int(size.sum()), bool)
    own[begin] = True  # a run comes first, then its parts
    terms = np.zeros(len(own), np.int64)
    terms[own], terms[~own] = stems[: len(runs)], stems[len(runs) :]
    of = size[at]
    take = np.repeat(begin[at] - (np.cumsum(of) - of), of) + np.arange(of.sum())
    place = np.repeat(np.repeat(np.arange(len(texts)), n), of)
    key = np.sort(terms[take] * m + place)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    tf = np.diff(np.r_[first, len(key)])
    key = key[first]
    number = {t: i for i, t in enumerate(names)}
    return number, np.r_[0, np.cumsum(np.bincount(key // m, minlength=len(number)))], (key % m).astype(np.int32), tf.astype(np.int32), np.bincount(place, minlength=len(texts)).astype(np.int64)


def blocks_of(number: dict[str, int], terms: list[tuple[str, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, weights) of the terms of a query that are there."""
    found = [(i, w) for t, w in terms if (i := number.get(t)) is not None]
    return np.array([i for i, _ in found], np.int64), np.array([x for _, x in found], float)


def whole_scores(at: np.ndarray, places: np.ndarray, gains: np.ndarray, n: int, own: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What the blocks `own` add to each of n places; block i has places[at[i] : at[i + 1]]."""
    sizes = at[own + 1] - at[own]
    take = np.repeat(at[own] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum()) if len(own) else np.zeros(0, np.int64)
    return np.bincount(places[take], np.repeat(weights, sizes) * gains[take], n)


SHARE = 0.003  # a term is a row of the matrix of common terms where the shares of texts and of queries that have it multiply to so much


class RangeScores:
    """What the blocks of a range add to its n places, for many queries at once.

    Terms that many texts and many queries have meet in a product of matrices;
    the postings of the others are added up for all queries of a chunk together.
    """

    def __init__(self, at: np.ndarray, places: np.ndarray, gains: np.ndarray, n: int, queries: tuple[np.ndarray, np.ndarray, np.ndarray]):
        """Block i has places[at[i] : at[i + 1]]; queries (begin of each, block of each term or -1, weight of each)."""
        begin, block, weight = queries
        size, idf = np.diff(at), np.zeros(len(at) - 1)
        here = block >= 0
        idf[block[here]] = weight[here]
        asked = np.bincount(block[here], minlength=len(size))
        self.at, self.places, self.n, self.begin, self.block = at, places, n, begin, block
        self.gains = gains * np.repeat(idf, size)
        common = np.flatnonzero(size * asked > SHARE * n * max(1, len(begin) - 1))
        self.row = np.full(len(size), -1)
        self.row[common] = np.arange(len(common))
        self.common = np.zeros((len(common), n))
        own = self.row[np.repeat(np.arange(len(size)), size)]
        self.common[own[own >= 0], places[own >= 0]] = self.gains[own >= 0]

    def of(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores of the queries from first to before last at each place, how many of its blocks are here)."""
        m, own = last - first, self.block[self.begin[first] : self.begin[last]]
        query = np.repeat(np.arange(m), np.diff(self.begin[first : last + 1]))[own >= 0]
        own = own[own >= 0]
        row = self.row[own]
        asked = np.zeros((m, len(self.common)))
        asked[query[row >= 0], row[row >= 0]] = 1
        out = asked @ self.common
        rare, q = own[row < 0], query[row < 0]
        size = self.at[rare + 1] - self.at[rare]
        take = np.repeat(self.at[rare] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        out += np.bincount(np.repeat(q * self.n, size) + self.places[take], self.gains[take], m * self.n).reshape(m, self.n)
        return out, np.bincount(query, minlength=m)
