"""The phrase of a row's tokens that is most like an answer, for many rows at once.

A row's phrases overlap: those that begin at one token are each other's prefixes, and all of them lie in one text. So one pass from each token on, over bits
that stand for the answer's letters, gives the edit distances of all its phrases, and the common substring that ends at each letter is found once a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Rows taken together; of long answers as many fewer.
ROWS = 256
_ONE = np.uint64(1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _common(equal: list[np.ndarray], row: np.ndarray) -> np.ndarray:
    """For each letter of the texts the length of the longest substring of its row's answer that ends there; ``equal``: bits of the answer's places with that letter."""
    run = np.zeros(len(row), np.int32)
    at, bits, n = np.flatnonzero(np.bitwise_or.reduce(equal)), None, 0
    while len(at):
        n += 1
        run[at] = n
        bits = [e[at] for e in equal] if bits is None else bits
        on = np.flatnonzero((at + 1 < len(row)) & (row[np.minimum(at + 1, len(row) - 1)] == row[at]))
        at, bits = at[on] + 1, [b[on] for b in bits]
        bits = [(b << _ONE | (bits[w - 1] >> np.uint64(63) if w else np.uint64(0))) & equal[w][at] for w, b in enumerate(bits)]
        some = np.flatnonzero(np.bitwise_or.reduce(bits))
        at, bits = at[some], [b[some] for b in bits]
    return run


def _passes(equal: list[np.ndarray], run: np.ndarray, start: np.ndarray, length: np.ndarray, said: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edit distances and longest common substrings of answers and all prefixes of stretches of letters, which come from long to short.

    Both are one array: those of all first letters, of all second ones, and so on; the third says where each begins. The distances are Myers's, in blocks of 64 letters of the answer.
    """
    reach = np.searchsorted(-length, -np.arange(length.max(initial=0)), side="left")  # how many are longer than that
    begin = _starts(reach)
    far, most = np.empty(begin[-1], np.int32), np.empty(begin[-1], np.int32)
    up, down = [np.full(len(start), ~np.uint64(0)) for _ in equal], [np.zeros(len(start), np.uint64) for _ in equal]
    score, best, last = said.astype(np.int32), np.zeros(len(start), np.int32), ((said - 1) % 64).astype(np.uint64)
    for t, n in enumerate(reach):
        at = start[:n] + t
        more, less = np.ones(n, np.uint64), np.zeros(n, np.uint64)
        for w, e in enumerate(equal):
            eq, pv, mv = e[at], up[w][:n], down[w][:n]
            xv = eq | mv
            eq |= less
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            if w == len(equal) - 1:
                score[:n] += (ph >> last[:n] & _ONE).astype(np.int32) - (mh >> last[:n] & _ONE).astype(np.int32)
            high, low = ph >> np.uint64(63), mh >> np.uint64(63)
            ph, mh = ph << _ONE | more, mh << _ONE | less
            up[w][:n], down[w][:n] = mh | ~(xv | ph), ph & xv
            more, less = high, low
        np.maximum(best[:n], np.minimum(run[at], t + 1), out=best[:n])
        far[begin[t] : begin[t + 1]], most[begin[t] : begin[t + 1]] = score[:n], best[:n]
    return far, most, begin


def _best(said: list[str], lines: list[str], boxed: list[str | None], least: int, longest: int, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, first token and number of tokens of each row's best phrase; 0 tokens without any. All answers take as many blocks of 64 letters."""
    n_rows, m = len(said), np.array([len(s) for s in said])
    tokens = np.array([x.count("\n") + 1 for x in lines])
    row_of, end_of = np.repeat(np.arange(n_rows), tokens), np.repeat(_starts(tokens)[1:], tokens)
    text = _codes("\n".join(lines))
    cuts = np.flatnonzero(text == 10)
    token_at = _starts(np.diff(np.concatenate([[-1], cuts, [len(text)]])) - 1)
    letters, row = text[text != 10], np.repeat(row_of, np.diff(token_at))

    own, own_row, place = _codes("".join(said)), np.repeat(np.arange(n_rows), m), np.arange(m.sum()) - np.repeat(_starts(m)[:-1], m)
    known, own_id = np.unique(own, return_inverse=True)
    other = len(known)
    found = np.minimum(np.searchsorted(known, letters), other - 1)
    kind = row * (other + 1) + np.where(known[found] == letters, found, other)
    equal = []
    for w in range((m.max() + 63) // 64):
        here, table = place // 64 == w, np.zeros(n_rows * (other + 1), np.uint64)
        np.bitwise_or.at(table, (own_row * (other + 1) + own_id)[here], _ONE << (place[here] % 64).astype(np.uint64))
        equal.append(table[kind])

    first = np.flatnonzero(np.arange(len(row_of)) + least <= end_of)
    begin, end = token_at[first], token_at[np.minimum(first + longest, end_of[first])]
    order = np.argsort(begin - end, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    of, size = row_of[first], m[row_of[first]]
    run = _common(equal, row) if weight else np.zeros(len(row), np.int32)
    far, most, offset = _passes(equal, run, begin[order], (end - begin)[order], size[order])

    whole = "".join("1" * n if b is None else b for b, n in zip(boxed, tokens.tolist(), strict=True))
    boxes = _starts(np.frombuffer(whole.encode(), np.uint8) == ord("1"))
    scores = np.full((longest - least + 1, len(first)), -1.0)
    for k in range(least, longest + 1):
        stop = np.minimum(first + k, len(row_of))
        length = token_at[stop] - begin
        use = np.flatnonzero((first + k <= end_of[first]) & (length > 0) & (boxes[stop] > boxes[first]))
        x = offset[length[use] - 1] + rank[use]
        scores[k - least, use] = np.minimum(1.0, weight * (most[x] / size[use]) + (1 - weight) * (1 - far[x] / np.maximum(size[use], length[use])))
    top = np.full(n_rows, -1.0)
    np.maximum.at(top, of, scores.max(axis=0, initial=-1.0))
    # Of equal scores the longest phrase, then the first one.
    key = np.full(n_rows, -1)
    width = len(row_of) + 1
    for k in range(least, longest + 1):
        same = np.flatnonzero((scores[k - least] == top[of]) & (scores[k - least] >= 0))
        np.maximum.at(key, of[same], k * width + width - 1 - first[same])
    some = key >= 0
    return top, np.where(some, width - 1 - key % width - _starts(tokens)[:-1], 0), np.where(some, key // width, 0)


def _batches(said: list[str | None], lines: list[str | None]) -> Iterator[list[int]]:
    """Rows with an answer whose answers take as many blocks of 64 letters, some at a time."""
    blocks: dict[int, list[int]] = {}
    for i, (s, x) in enumerate(zip(said, lines, strict=True)):
        if s and x is not None:
            blocks.setdefault((len(s) + 63) // 64, []).append(i)
    for n, rows in blocks.items():
        step = max(1, ROWS // n)
        for i in range(0, len(rows), step):
            yield rows[i : i + step]


def most_alike(said: list[str | None], lines: list[str | None], boxed: list[str | None], least: int, longest: int, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the score of the phrase of ``least`` to ``longest`` tokens most like the answer, its first token from 0 and its number of tokens; 0 tokens without any.

    ``lines``: normal forms of the tokens, one a line; ``boxed``: a 1 for each token that has a box, null if all do. The score is ``weight`` times the share of the answer that is a common
    substring, and the rest times one minus the edit distance over the longer length. Phrases without letters or boxes don't count.
    """
    score, at, n = np.zeros(len(said)), np.zeros(len(said), np.int32), np.zeros(len(said), np.int32)
    for rows in _batches(said, lines):
        take = lambda values: [values[i] for i in rows]  # noqa: B023, E731
        score[rows], at[rows], n[rows] = _best(take(said), take(lines), take(boxed), least, longest, weight)
    return score, at, n


def words_alike(words: list[list[str]], lines: list[str], boxed: list[str | None]) -> list[list[dict | None]]:
    """For each row and each of its words the likeness (N14) and place from 0 of the token in a box that is most like it, the first of equals; null for words that equal a token, or without boxes."""
    pairs = []
    for i, own in enumerate(words):
        have = set(lines[i].split("\n"))
        pairs += [(i, k) for k, w in enumerate(own) if w not in have]
    found: list[list[dict | None]] = [[None] * len(own) for own in words]
    score, at, n = most_alike([words[i][k] for i, k in pairs], [lines[i] for i, _ in pairs], [boxed[i] for i, _ in pairs], 1, 1, 0.0)
    for j, (i, k) in enumerate(pairs):
        if n[j] and score[j] > 0:
            found[i][k] = {"score": float(score[j]), "at": int(at[j])}
        elif (first := 0 if boxed[i] is None else boxed[i].find("1")) >= 0:  # all alike, those without letters too
            found[i][k] = {"score": 0.0, "at": first}
    return found
