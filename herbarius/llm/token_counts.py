"""Exact token counts at every prefix of a text, for a byte-level BPE with word ends.

A word's encoding is the only sequence of tokens in which each neighbouring pair stays as it
is when the pair alone is encoded.  So the last token of each prefix of a word follows from
the last tokens of shorter prefixes: one pass over a word stores, for every prefix, its last
token and so its exact count.  Where a text is cut inside a word, the last token of the cut
prefix carries the word end, which is one more step on the stored prefixes.  A prefix of a
text has the tokens of its whole words plus those of the word that it cuts, so budgets and
truncation need sums of stored counts and no encoding.

Prefixes are measured in code points of the normalised text (NFC, lower case).
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_text

#: The Unicode property White_Space, which is less than Python's \\s.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words kept by a Python worker before it starts anew.
CACHE_WORDS = 400_000


def _bytes_as_chars() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _letters_and_numbers() -> tuple[str, str]:
    """Character classes of the Unicode categories L and N, as ranges."""
    out = {"L": [], "N": []}
    for kind, ranges in out.items():
        start = None
        for c in range(sys.maxunicode + 2):
            inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
            if inside and start is None:
                start = c
            elif not inside and start is not None:
                ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
    return "".join(out["L"]), "".join(out["N"])


class PrefixCounter:
    """Counts tokens at prefixes, as the file's own library would give them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.chars = _bytes_as_chars()
        self.known = set(model["vocab"])
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.longest = max(map(len, self.known))
        letters, numbers = _letters_and_numbers()
        self.word = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.inner = {t for t in self.known if not t.endswith(self.end)}
        self.final = {t.removesuffix(self.end) for t in self.known if t.endswith(self.end)}
        self.fits: dict[tuple[str, str], bool] = {}
        self.counts: dict[str, int] = {}  # of parts between spaces, which may be several words
        self.prefixes: dict[str, tuple[bytes, int]] = {}  # of a word: lengths of its prefixes' last tokens (0: none); its count

    def _alone(self, left: str, right: str) -> bool:
        """Whether the two tokens stay as they are when just the two are encoded."""
        if (left, right) in self.fits:
            return self.fits[left, right]
        body = right.removesuffix(self.end)
        parts = [*left, *body]  # without a left one: whether the right one is encoded as itself
        if body != right:
            parts[-1] += self.end
        while len(parts) > 1:
            best, at = min(((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[left, right] = parts == [left, right] or parts == [right] and not left
        return self.fits[left, right]

    def learn(self, words: list[str]) -> None:
        """Store the prefixes of new words; sorted words share those of their beginnings."""
        before, lasts, counts, sizes = "", [""], [0], bytearray()
        known, fits, longest = self.inner, self.fits, self.longest
        for word in sorted(words):
            text = self.spelled(word)
            same = 0
            for x, y in zip(before, text, strict=False):
                if x != y:
                    break
                same += 1
            del lasts[same + 1 :], counts[same + 1 :], sizes[same:]
            for i in range(same + 1, len(text) + 1):
                for a in range(i - 1, max(-1, i - longest - 1), -1):  # one start alone is right; short tokens are the likelier
                    piece = text[a:i]
                    if piece in known:
                        key = lasts[a], piece
                        if key[0] is not None and (fits[key] if key in fits else self._alone(*key)):
                            lasts.append(piece)
                            counts.append(counts[a] + 1)
                            sizes.append(i - a)
                            break
                else:  # no encoding goes on from here, though one may end here
                    lasts.append(None)
                    counts.append(0)
                    sizes.append(0)
            before = text
            self.prefixes[word] = bytes(sizes), self._ended(text, len(text), lasts, counts)

    def _ended(self, text: str, i: int, lasts: list, counts: list) -> int:
        """The count of the word that ends after i bytes."""
        for a in range(i - 1, max(-1, i - self.longest - 1), -1):
            piece = text[a:i]
            if piece in self.final and lasts[a] is not None:
                key = lasts[a], piece + self.end
                if self.fits[key] if key in self.fits else self._alone(*key):
                    return counts[a] + 1
        raise ValueError(f"no encoding of {text[:i]!r}")

    def spelled(self, word: str) -> str:
        return "".join(map(self.chars.__getitem__, word.encode("utf-8", "surrogatepass")))

    def cuts(self, word: str) -> list[int]:
        """Counts of the word cut after each of its code points, from its stored prefixes."""
        text, (sizes, whole) = self.spelled(word), self.prefixes[word]
        lasts, counts, out, at = [""], [0], [], 0
        for i, n in enumerate(sizes, 1):
            lasts.append(text[i - n : i] if n else None)
            counts.append(counts[i - n] + 1 if n else 0)
        if word[0] == "'" and len(word) > 2:  # a cut contraction falls apart into ' and letters
            return [self.cuts_of("'")[-1], *(self.cuts_of("'")[-1] + self.cuts_of(word[1:i])[-1] for i in range(2, len(word))), whole]
        for c in word:
            at += len(c.encode("utf-8", "surrogatepass"))
            out.append(self._ended(text, at, lasts, counts))
        return out

    def cuts_of(self, word: str) -> list[int]:
        self.ensure_words([word])
        return self.cuts(word)

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # the library lowers each character by itself
                return "".join(map(str.lower, text))
        return text.lower()

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """(special, text) parts: the library takes special strings out before it normalises."""
        if self.special is None or "<|" not in text:
            return [(False, text)]
        return [(bool(i % 2), x) for i, x in enumerate(self.special.split(text)) if x]

    def ensure_words(self, words) -> None:
        new = [w for w in words if w not in self.prefixes]
        if new:
            self.learn(new)

    def ensure(self, chunks) -> None:
        """Count new parts between spaces."""
        new = {c: [c] if c.isalpha() else self.word.findall(c) for c in chunks if c not in self.counts}  # isalpha: category L throughout
        self.ensure_words({w for words in new.values() for w in words})
        for c, words in new.items():
            self.counts[c] = sum(self.prefixes[w][1] for w in words)

    def forget(self) -> None:
        if len(self.counts) > CACHE_WORDS or len(self.prefixes) > CACHE_WORDS:
            self.counts.clear()
            self.prefixes.clear()

    def at_every_prefix(self, text: str) -> list[int]:
        """Counts at each prefix, from the empty one to the whole text."""
        out, total = [0], 0
        for special, part in self.parts(text):
            if special:
                out += [total + 1] * len(part)
                total += 1
                continue
            part, at = self.normal(part), 0
            self.ensure_words(set(self.word.findall(part)))
            for m in self.word.finditer(part):
                out += [total] * (m.start() - at)
                steps = self.cuts(m[0])
                out += [total + s for s in steps]
                total += steps[-1]
                at = m.end()
            out += [total] * (len(part) - at)
        return out


def _chunks(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit, fit_chars`` of every row.

    ``fit_chars`` answers the truncation question: the code points of the longest prefix of
    the normalised text that has at most ``limit`` tokens (the whole text if it fits).

    A null text counts as an empty one: 0 bytes, 0 tokens.  Ids are passed on as they are,
    null or repeated; other columns are left out.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"
    chosen = df.select(id_col, text_col)
    arrow = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("fit_chars", pa.int64())])

    def run(batches):
        c = counter(path)

        def work(ids, texts):
            c.forget()
            found = []
            for text in texts:
                parts = c.parts(text or "")
                plain = [c.normal(p) for s, p in parts if not s]
                special = [p for s, p in parts if s]
                found.append((len(special), sum(map(len, plain)) + sum(map(len, special)), [x for p in plain for x in _chunks(p)]))
            c.ensure({x for *_, chunks in found for x in chunks})
            totals = [n + sum(map(c.counts.__getitem__, chunks)) for n, _, chunks in found]
            fits = [_fit(c, t, limit) if n > limit else chars for t, n, (_, chars, _) in zip(texts, totals, found, strict=True)]
            return {"n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": totals, "over_limit": [n > limit for n in totals], "fit_chars": fits}

        for batch in batches:
            ids = batch.column(0)
            done = 0
            for out in by_text(work, id_col, text_col, arrow)([batch]):
                yield pa.RecordBatch.from_arrays([ids.slice(done, out.num_rows), *out.columns], names=[id_col, *arrow.names])
                done += out.num_rows

    return chosen.mapInArrow(run, schema)


def _fit(c: PrefixCounter, text: str, limit: int) -> int:
    """Code points of the longest prefix with at most ``limit`` tokens."""
    total, at, best = 0, 0, 0
    for special, part in c.parts(text):
        if special:
            if total + 1 > limit:
                return best
            total, at = total + 1, at + len(part)
            best = at
            continue
        part = c.normal(part)
        for m in c.word.finditer(part):
            c.ensure_words([m[0]])
            whole = c.prefixes[m[0]][1]
            if total + whole > limit:
                inside = [i + 1 for i, s in enumerate(c.cuts(m[0])) if total + s <= limit]
                return at + m.start() + (inside[-1] if inside else 0)
            total += whole
        at += len(part)
        best = at
    return best


def prefix_token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, prefix_tokens array<int>``: element i is the count of the first i code points
    of the normalised text; null texts give ``[0]``."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        c = counter(path)
        for batch in batches:
            for i in range(batch.num_rows):
                got = c.at_every_prefix(batch.column(1)[i].as_py() or "")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([got], type=pa.list_(pa.int32()))], names=[id_col, "prefix_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, prefix_tokens array<int>")
