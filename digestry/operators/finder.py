"""The keywords of a dictionary in texts, by the texts' runs.

A text is cut into its runs of letters and digits (and, if a keyword asks for them, of other characters).  A keyword
that is one run itself is in a text exactly when it is in one of the text's runs, so each distinct run of a batch of texts is
looked at once, and remembered for later batches.  A keyword of several runs is looked for in the texts that hold the one
of its runs that fewest such keywords have, and is tested on the whole text.  The result is that of ``contains`` for every
keyword, whatever its characters.

A new run costs one look-up per place and length of short keywords (up to ``HEAD`` characters), and one per place for
all longer ones, which are found by their first ``HEAD`` characters.  Texts and keywords are lower-cased before.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Characters by which a long keyword is found.
HEAD = 12
# Runs whose keywords a task remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARACTERS = 1 << 18, 64
# Bytes of texts that are cut into runs at once.
AT_ONCE = 1 << 23

WORD, OTHER = r"[\pL\pN]+", r"[^\pL\pN]+"
_NONE = np.zeros(0, np.int64)


def _runs(texts: pa.Array, between: str) -> pa.ListArray:
    return pc.split_pattern_regex(texts, pattern=between)


class Finder:
    """Numbers of the keywords in texts.  ``lows`` are the lower-cased keywords by number; a null one is in no text."""

    def __init__(self, lows: list[str | None]):
        at: dict[str, list[int]] = {}
        for number, low in enumerate(lows):
            if low is not None:
                at.setdefault(low, []).append(number)
        self.always = np.array(at.pop("", []), np.int64)
        self.short, self.long, self.phrases, self.first_phrase = {}, {}, [], len(lows)
        words = [[run for run in runs if run] for runs in _runs(pa.array([*at], pa.string()), OTHER).to_pylist()]
        one = {low: tuple(numbers) for (low, numbers), runs in zip(at.items(), words, strict=True) if not runs or runs[0] == low}
        several = {low: runs for low, runs in zip(at, words, strict=True) if low not in one}
        self.between = [OTHER, WORD] if any(not runs for runs in words) else [OTHER]
        shared = Counter(run for runs in several.values() for run in {*runs})
        for low, runs in several.items():
            rarest = min(runs, key=lambda r: (shared[r], -len(r)))
            one[rarest] = (*one.get(rarest, ()), self.first_phrase + len(self.phrases))
            self.phrases.append((low, np.array(at[low], np.int64)))
        for low, numbers in one.items():
            if len(low) <= HEAD:
                self.short[low] = numbers
            else:
                self.long.setdefault(low[:HEAD], {}).setdefault(len(low), {})[low] = numbers
        self.sizes = sorted({*map(len, self.short)})
        self.known: dict[str, tuple[int, ...]] = {}

    def _of_run(self, run: str) -> tuple[int, ...]:
        found, short = [], self.short
        for size in self.sizes:
            if size > len(run):
                break
            for i in range(len(run) - size + 1):
                if numbers := short.get(run[i : i + size]):
                    found.extend(numbers)
        if self.long:
            for i in range(len(run) - HEAD):
                for size, words in self.long.get(run[i : i + HEAD], {}).items():
                    found.extend(words.get(run[i : i + size], ()))
        out = (*{*found},)
        if len(run) <= REMEMBERED_CHARACTERS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[run] = out
        return out

    def _met(self, runs: pa.ListArray, room: int) -> np.ndarray:
        """text * ``room`` + number, each once, in order."""
        values = runs.flatten().dictionary_encode()
        known, of_run = self.known, self._of_run
        of = [known[run] if run in known else of_run(run) for run in values.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, of), np.int64, len(of))
        flat, starts = np.fromiter(chain.from_iterable(of), np.int64, sizes.sum()), np.cumsum(sizes) - sizes
        codes = values.indices.to_numpy()
        text = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
        some = sizes[codes] > 0
        pairs = _distinct(text[some] * max(1, len(of)) + codes[some])
        text, codes = np.divmod(pairs, max(1, len(of)))
        many = sizes[codes]
        ends = np.cumsum(many)
        number = flat[np.arange(many.sum()) + np.repeat(starts[codes] - (ends - many), many)]
        return _distinct(np.repeat(text, many) * room + number)

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many keywords each text holds, and their numbers, in order."""
        room = self.first_phrase + len(self.phrases) + 1
        found = [self._met(_runs(texts, between), room) for between in self.between]
        if len(self.always):
            found.append((np.arange(len(texts))[:, None] * room + self.always).ravel())
        found = _distinct(np.concatenate(found)) if len(found) > 1 else found[0]
        text, number = np.divmod(found, room)
        if self.phrases:
            asked = number >= self.first_phrase
            kept = [found[~asked]]
            for t, n in zip(text[asked].tolist(), number[asked].tolist()):
                low, numbers = self.phrases[n - self.first_phrase]
                if low in texts[t].as_py():
                    kept.append(t * room + numbers)
            text, number = np.divmod(_distinct(np.concatenate(kept)), room)
        return np.bincount(text, minlength=len(texts)), number


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


# What the Python tasks of one worker share: a finder is made once for a dictionary; the last two are kept.
_LAST: dict[str, Finder] = {}


class Listed:
    """A dictionary on its way to the Python tasks; its keywords are numbered by their place in it."""

    def __init__(self, entries: pa.Table):
        self.name, self.entries = uuid.uuid4().hex, entries.combine_chunks()

    def _each(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.name not in _LAST:
            if len(_LAST) > 1:
                _LAST.pop(next(iter(_LAST)))
            _LAST[self.name] = Finder(self.entries["_low"].to_pylist())
        texts = texts.cast(pa.string()).fill_null("")
        parts = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // AT_ONCE
        ends = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(texts)]
        for start, end in zip(ends, ends[1:]):
            yield _LAST[self.name].numbers(texts[start:end])

    def numbers(self, texts: pa.Array) -> pa.Array:
        """The numbers of the keywords in each text; none in a null one."""
        each = [(counts, number.astype(np.int32)) for counts, number in self._each(texts)]
        ends = np.cumsum(np.concatenate([_NONE, *[counts for counts, _ in each]]))
        return pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *[n for _, n in each]])))

    def found(self, texts: pa.Array) -> pa.Array:
        """(keyword, weight) of what each text holds."""
        numbers = self.numbers(texts)
        rows = self.entries.take(numbers.values)
        each = pa.StructArray.from_arrays([rows[c].combine_chunks() for c in ("keyword", "weight")], names=["keyword", "weight"])
        return pa.ListArray.from_arrays(numbers.offsets, each)

    def scores(self, texts: pa.Array) -> pa.Array:
        """The summed weights of what each text holds; null if one of them is."""
        weights = self.entries["weight"].combine_chunks()
        unknown = weights.is_null().to_numpy(zero_copy_only=False)
        weights, out, nulls = weights.fill_null(0.0).to_numpy(), [np.zeros(0)], [np.zeros(0, bool)]
        for counts, number in self._each(texts):
            text = np.repeat(np.arange(len(counts)), counts)
            out.append(np.bincount(text, weights[number], len(counts)))
            nulls.append(np.bincount(text, unknown[number], len(counts)) > 0)
        return pa.array(np.concatenate(out), pa.float64(), mask=np.concatenate(nulls))
