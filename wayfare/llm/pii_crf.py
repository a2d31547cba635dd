"""A linear-chain conditional random field over word shapes, in numpy batches.

Trained on a small labelled table of (words, tags). A word's features come from
its shape alone; the neighbours' shapes count as features as well, so that a
word's emission is a sum of three cached vectors. Decoding is Viterbi over
batches of sequences of similar length.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable
from functools import cache

import numpy as np

from wayfare.llm.pii_rules import KINDS, luhn

TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Words that say what follows; their features carry the word itself.
CUES = frozenset("at dot phone tel call mobile fax email mail ip host card visa payment order no ref version date com org net".split())
_RUN = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]")
_SPELT = re.compile(r"[\[(](?:at|dot)[\])]|^(?:at|dot)$", re.I)
_EDGE = "".join(map(chr, (*range(33, 48), *range(58, 64), 91, 93, 94, 95, 96, 123, 124, 125, 126)))


def shape(word: str) -> str:
    """Letters and digits become classes; digit runs keep their length up to 20."""
    parts = []
    for run in _RUN.findall(word):
        c = run[0]
        if c.isdigit():
            parts.append("9" * min(len(run), 20))
        elif c.islower() and c.isascii():
            parts.append("a")
        elif c.isupper() and c.isascii():
            parts.append("A")
        else:
            parts.append("x" if c.isalpha() else c)
    return "".join(parts)


def features(word: str) -> list[str]:
    word = _SPELT.sub(lambda m: m[0].lower(), word)
    bare = word.strip(_EDGE)
    digits = "".join(re.findall(r"[0-9]", word))
    got = ["bias", f"s={shape(bare)}", f"n={min(len(digits), 20)}", f"first={shape(word[:1])}", f"last={shape(word[-1:])}"]
    if bare.lower() in CUES:
        got.append(f"w={bare.lower()}")
    if "@" in word:
        got.append("@")
    got += [f"has{c}" for c in ".-()+/:_=[]" if c in word]
    if re.search(r"[A-Za-z]", word):
        got.append("letters")
    if 12 <= len(digits) <= 19 and luhn(digits):
        got.append("luhn")
    parts = bare.split(".")
    if len(parts) == 4 and all(p.isdigit() and int(p[-9:]) <= 255 for p in parts):
        got.append("quad")
    return got


class Field:
    """Weights of (offset, feature, tag) and of tag pairs."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.names, self.emit, self.step = names, emit, step
        self.cache: dict[str, np.ndarray] = {}

    def vectors(self, word: str) -> np.ndarray:
        """(3, tags): what the word adds to its predecessor, itself and its successor."""
        got = self.cache.get(word)
        if got is None:
            ids = [self.names[f] for f in features(word) if f in self.names]
            got = self.emit[:, ids, :].sum(axis=1)
            if len(self.cache) > 100_000:
                self.cache.clear()
            self.cache[word] = got
        return got

    def emissions(self, words: list[str]) -> np.ndarray:
        v = np.stack([self.vectors(w) for w in words])
        scores = v[:, 1].copy()
        scores[:-1] += v[1:, 0]
        scores[1:] += v[:-1, 2]
        return scores

    def decode(self, sequences: list[list[str]], cells: int = 200_000) -> list[list[int]]:
        """Best tags of every sequence; one numpy batch per group of similar lengths."""
        order = sorted((i for i, s in enumerate(sequences) if s), key=lambda i: len(sequences[i]))
        out: list[list[int]] = [[] for _ in sequences]
        while order:
            longest = len(sequences[order[-1]])
            take = order[-max(1, cells // longest) :]
            del order[-len(take) :]
            for i, path in zip(take, self._viterbi([self.emissions(sequences[j]) for j in take])):
                out[i] = path
        return out

    def _viterbi(self, scores: list[np.ndarray]) -> list[list[int]]:
        n, longest, k = len(scores), max(map(len, scores)), len(TAGS)
        lengths = np.array([len(s) for s in scores])
        padded = np.zeros((longest, n, k))
        for i, s in enumerate(scores):
            padded[: len(s), i] = s
        best = padded[0] + _START
        back = np.zeros((longest, n, k), np.int8)
        for t in range(1, longest):
            through = best[:, :, None] + self.step[None]
            back[t] = through.argmax(axis=1)
            new = through.max(axis=1) + padded[t]
            live = (t < lengths)[:, None]
            best = np.where(live, new, best)
            back[t] = np.where(live, back[t], np.arange(k))
        path = np.zeros((longest, n), np.int64)
        path[-1] = best.argmax(axis=1)
        for t in range(longest - 1, 0, -1):
            path[t - 1] = back[t][np.arange(n), path[t]]
        return [path[: lengths[i], i].tolist() for i in range(n)]


def _forbidden() -> tuple[np.ndarray, np.ndarray]:
    start, step = np.zeros(len(TAGS)), np.zeros((len(TAGS), len(TAGS)))
    for j, tag in enumerate(TAGS):
        if tag[0] == "I":
            start[j] = -1e4
            for i, before in enumerate(TAGS):
                if before[2:] != tag[2:]:
                    step[i, j] = -1e4
    return start, step


_START, _STEP = _forbidden()


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: Iterable[tuple[list[str], list[str]]], rounds: int = 50, rate: float = 0.3, ridge: float = 0.02) -> Field:
    """Maximum likelihood with a ridge, by full-batch AdaGrad on forward-backward marginals."""
    table = [(w, t) for w, t in table if w]
    names: dict[str, int] = {}
    words = [[[names.setdefault(f, len(names)) for f in features(x)] for x in w] for w, _ in table]
    n, longest, k, m = len(table), max((len(w) for w in words), default=1), len(TAGS), len(names)
    lengths = np.array([len(w) for w in words])
    gold = np.zeros((longest, n), np.int64)
    rows, cells = [], []  # every (feature and offset, position) that is on
    for i, (w, (_, tags)) in enumerate(zip(words, table)):
        gold[: len(w), i] = [TAGS.index(t) for t in tags]
        for t, ids in enumerate(w):
            for offset in (0, 1, 2):
                to = t + offset - 1
                if 0 <= to < len(w):
                    rows += [offset * m + f for f in ids]
                    cells += [to * n + i] * len(ids)
    rows_, cells_ = np.array(rows, np.int64), np.array(cells, np.int64)
    order = np.argsort(rows_, kind="stable")
    by_cell = np.argsort(cells_, kind="stable")
    live = np.arange(longest)[:, None] < lengths[None]
    emit, step = np.zeros((3 * m, k)), np.zeros((k, k))
    grown = [np.full_like(emit, 1e-6), np.full_like(step, 1e-6)]
    one = np.eye(k)[gold] * live[..., None]
    pairs = np.zeros((k, k))
    for t in range(1, longest):
        np.add.at(pairs, (gold[t - 1][live[t]], gold[t][live[t]]), 1)

    def spread(values: np.ndarray, keys: np.ndarray, sort: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, k))
        sorted_keys = keys[sort]
        first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
        out[sorted_keys[first]] = np.add.reduceat(values[sort], first, axis=0)
        return out

    for _ in range(rounds):
        scores = spread(emit[rows_], cells_, by_cell, longest * n).reshape(longest, n, k)
        moves = step + _STEP
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[0] = scores[0] + _START
        for t in range(1, longest):
            new = scores[t] + _logsum(ahead[t - 1][:, :, None] + moves, 1)
            ahead[t] = np.where(live[t][:, None], new, ahead[t - 1])
        total = _logsum(ahead[-1], 1)
        seen = np.zeros((k, k))
        for t in range(longest - 1, 0, -1):
            onward = scores[t] + behind[t]
            got = _logsum(moves[None] + onward[:, None, :], 2)
            behind[t - 1] = np.where(live[t][:, None], got, behind[t])
            both = np.exp(ahead[t - 1][:, :, None] + moves[None] + onward[:, None, :] - total[:, None, None])
            seen += both[live[t]].sum(axis=0)
        marginal = np.exp(ahead + behind - total[None, :, None]) * live[..., None]
        wrong = (one - marginal).reshape(longest * n, k)
        slopes = [spread(wrong[cells_], rows_, order, 3 * m) - ridge * emit, pairs - seen - ridge * step]
        for weights, slope, sums in zip((emit, step), slopes, grown):
            sums += slope**2
            weights += rate * slope / np.sqrt(sums)
    return Field(names, emit.reshape(3, m, k), step + _STEP)


def labelled_table(rows: int = 600, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """A small labelled table, made by rule: personal data in many written forms, and look-alikes.

    Look-alikes (dates, prices, versions, keys, hashes, order numbers, digit runs
    that fail Luhn) are tagged O, so that the field learns to leave them alone.
    """
    r = random.Random(seed)

    def word() -> str:
        w = "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(1, 9)))
        return r.choice((w, w, w, w.capitalize(), w.upper())) + r.choice(("", "", "", "", ",", ".", "%%%", "###", "!!"))

    def num(n: int) -> str:
        return str(r.randint(1, 9)) + "".join(r.choice("0123456789") for _ in range(n - 1))

    def card_digits(good: bool = True) -> str:
        body = num(15)
        last = next(d for d in "0123456789" if luhn(body + d) == good)
        return body + last

    def card() -> list[str]:
        d = card_digits()
        return r.choice(([d], [d[:4], d[4:8], d[8:12], d[12:]], ["-".join((d[:4], d[4:8], d[8:12], d[12:]))], [".".join((d[:4], d[4:8], d[8:12], d[12:]))]))

    def ip() -> list[str]:
        quad = ".".join(str(r.randint(1, 255)) for _ in range(4))
        return [quad + r.choice(("", "", "", ",", ".", f":{num(4)}"))]

    def email() -> list[str]:
        name = r.choice((word, word))().strip(".,%#!").lower() + r.choice(("", f".{num(2)}", f"_{num(1)}"))
        host, top = word().strip(".,%#!").lower(), r.choice(("com", "org", "net"))
        return r.choice(
            ([f"{name}@{host}.{top}"], [f"<{name}@{host}.{top}>"], [name, "[at]", host, "[dot]", top], [name, "(at)", f"{host}.{top}"], [name, "(at)", host, "(dot)", top],
             [f"{name}[at]{host}[dot]{top}"], [f"{name}(at){host}(dot){top}"], *[[name, "at", host, "dot", top]] * 3)
        )

    def phone() -> list[str]:
        return r.choice(
            ([f"+{num(1)}", f"({num(3)})", f"{num(3)}-{num(4)}"], [f"+{num(2)}", num(3), num(7)], [f"+{num(11)}"], [f"({num(3)})", f"{num(3)}-{num(4)}"], [f"{num(3)}-{num(3)}-{num(4)}"], [f"00{num(2)}", num(3), num(6)])
        )

    def other() -> list[str]:
        return r.choice(
            ([num(r.randint(1, 8))], [card_digits(False)], [f"{num(4)}-{r.randint(10, 12)}-{r.randint(10, 28)}"], [f"${num(3)}.{num(2)}"], [f"{num(1)}.{num(1)}.{num(1)}"], [f"v{num(1)}.{num(2)}"],
             ["".join(r.choice("0123456789abcdef") for _ in range(r.randint(12, 32)))], [f"password={''.join(r.choice('0123456789abcdef') for _ in range(18))}"],
             ["AKIA" + "".join(r.choice("ABCDEFGHJKLMNPQRSTUVXYZ0123456789") for _ in range(16))], [f"#{num(6)}"], [f"{num(2)}:{num(2)}"], [num(4)], [f"{num(2)}%"], [f"{num(3)}.{num(3)}.{num(3)}.{num(3)}9"], ["@" + word().strip(".,%#!").lower()], [num(r.randint(20, 30))],
             [word(), "at", word()], ["at", num(2)], [word(), "at", word(), word()], ["the", "dot", word()], ["at", "the", "dot", word()])
        )

    cue = {"email": ("email", "mail"), "ip": ("ip", "host"), "card": ("card", "visa"), "phone": ("tel", "phone", "call")}
    made = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(rows):
        words, tags = [], []
        for _ in range(r.randint(1, 2)):
            kind = r.choice((*KINDS, "O", "O", "O"))
            for _ in range(r.randint(0, 3)):
                words.append(word()), tags.append("O")
            if kind in cue and r.random() < 0.3:
                words.append(r.choice(cue[kind])), tags.append("O")
            got = made[kind]() if kind in made else other()
            words += got
            tags += ["O"] * len(got) if kind == "O" else [f"B-{kind}"] + [f"I-{kind}"] * (len(got) - 1)
            for _ in range(r.randint(1, 3)):
                words.append(word()), tags.append("O")
        out.append((words, tags))
    return out


@cache
def default_field() -> Field:
    return train(labelled_table())
