"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

The steps are those of Nong, Zhang and Chan (2009): classify suffixes as smaller or larger than their right neighbour, sort
the leftmost smaller ones by their substrings (recursively where names repeat), and induce the order of all others from
theirs.  Induction goes through the buckets of first characters; what a bucket induces is computed at once, and again
while suffixes of the same bucket follow (runs of one character).
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket; names of deeper levels beyond it are ranked by doubling.
BUCKETS = 1024


def smaller_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one to its right; the last character is the unique smallest."""
    n = len(text)
    rising = np.zeros(n, bool)
    rising[-1] = True
    if n > 1:
        step = np.sign(text[1:] - text[:-1])
        # In a run of equal characters the type is that of the run's end.
        ends = np.where(step != 0, np.arange(n - 1), n - 1)
        ends = np.minimum.accumulate(ends[::-1])[::-1]
        rising[:-1] = np.append(step, 1)[ends] > 0
    return rising


def _split(items: np.ndarray, chars: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append items to the lists of their characters, in order."""
    if not len(items):
        return
    # Two-byte keys are sorted by radix; alphabets here have at most BUCKETS characters.
    order = np.argsort(chars.astype(np.uint16), kind="stable")
    sorted_chars = chars[order]
    cuts = np.flatnonzero(sorted_chars[1:] != sorted_chars[:-1]) + 1
    for part in np.split(order, cuts):
        into[int(chars[part[0]])].append(items[part])


def _induce(text: np.ndarray, rising: np.ndarray, heads: list[np.ndarray], size: int) -> np.ndarray:
    """Suffix array induced from the leftmost smaller suffixes of each bucket, given in order."""
    none = np.zeros(0, np.int64)
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]
    in_bucket = [none] * size

    def before(items: np.ndarray, want_rising: bool) -> np.ndarray:
        previous = items[items > 0] - 1
        return previous[rising[previous] == want_rising]

    for c in range(size):
        done, batch = [], np.concatenate(larger[c]) if larger[c] else none
        while len(batch):
            done.append(batch)
            previous = before(batch, False)
            chars = text[previous]
            _split(previous[chars != c], chars[chars != c], larger)
            batch = previous[chars == c]
        in_bucket[c] = np.concatenate(done) if done else none
        if len(heads[c]):
            previous = before(heads[c], False)
            _split(previous, text[previous], larger)
    smaller: list[list[np.ndarray]] = [[] for _ in range(size)]
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        done, batch = [], np.concatenate(smaller[c]) if smaller[c] else none
        while len(batch):
            done.append(batch)
            previous = before(batch, True)
            chars = text[previous]
            _split(previous[chars != c], chars[chars != c], smaller)
            batch = previous[chars == c]
        back = in_bucket[c][::-1]
        previous = before(back, True)
        _split(previous, text[previous], smaller)
        found = np.concatenate(done) if done else none
        if c == text[-1]:
            # The end of the text is smallest and nothing induces it.
            found = np.append(found[found != len(text) - 1], len(text) - 1)
            previous = before(found[-1:], True)
            _split(previous[text[previous] < c], text[previous[text[previous] < c]], smaller)
        out += [found, back]
    return np.concatenate(out)[::-1]


def _by_bucket(items: np.ndarray, text: np.ndarray, size: int) -> list[np.ndarray]:
    chars = text[items]
    order = np.argsort(chars, kind="stable")
    return np.split(items[order], np.searchsorted(chars[order], np.arange(1, size)))


def _names(text: np.ndarray, heads: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Name of the substring that begins at each of ``ordered`` (sorted), equal where substrings are."""
    length = np.zeros(len(text), np.int64)
    length[heads[:-1]] = np.diff(heads) + 1
    length[heads[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    left = np.flatnonzero(same)
    t = 0
    while len(left):
        going = t < length[a[left]]
        left = left[going]
        differ = text[a[left] + t] != text[b[left] + t]
        same[left[differ]] = False
        left = left[~differ]
        t += 1
    return np.concatenate([[0], np.cumsum(~same)])


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a sequence with a large alphabet by their first ``depth`` names, by rank doubling."""
    n, rank, span = len(names), names.astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - span] = rank[span:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key)
        steps = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        span *= 2
        if steps[-1] == n - 1 or span >= min(n, depth):
            return order


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of a sequence of small non-negative integers that ends with its unique smallest.

    With ``depth``, suffixes that agree in their first ``depth`` characters may stay in any order.
    """
    text = np.asarray(text, np.int64)
    depth = len(text) if depth is None else depth
    if len(text) == 1:
        return np.zeros(1, np.int64)
    size = int(text.max()) + 1
    rising = smaller_types(text)
    heads = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    place = np.zeros(len(text), bool)
    place[heads] = True
    rough = _induce(text, rising, _by_bucket(heads, text, size), size)
    ordered = rough[place[rough]]
    names = _names(text, heads, ordered)
    if names[-1] < len(heads) - 1:
        at = np.empty(len(text), np.int64)
        at[ordered] = names
        reduced = at[heads]
        # Leftmost smaller suffixes are at least two characters apart.
        names_deep = depth // 2 + 1
        ordered = heads[suffix_array(reduced, names_deep) if names[-1] < BUCKETS else _doubled(reduced, names_deep)]
    return _induce(text, rising, _by_bucket(ordered, text, size), size)


def permuted_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, by place in the text, of each suffix in ``order`` with the one before it, counted up to ``most``.

    ``order`` holds all or some of the suffixes; places that it lacks, and its first, have 0.  ``text`` is an array of
    bytes followed by at least ``most + 8`` further bytes of padding.
    """
    # Eight bytes from every place on, compared at once.
    words = np.lib.stride_tricks.as_strided(text[:8].view("<u8"), shape=(len(text) - 7,), strides=(1,))
    prefix = np.zeros(len(text), np.int64)
    here, before = order[1:], order[:-1]
    done = 0
    while len(here) and done < most:
        differ = words[here + done] ^ words[before + done]
        ends = differ != 0
        low = differ[ends]
        low &= ~low + np.uint64(1)
        prefix[here[ends]] = done + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        here, before = here[~ends], before[~ends]
        done += 8
    prefix[here] = most
    return np.minimum(prefix, most)
