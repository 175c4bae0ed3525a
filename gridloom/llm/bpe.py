"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A word is a row of symbols, its bytes, the last one marked as the word's end where the vocabulary has an end-of-word suffix.
Of every prefix of a word the encoding has one last token, and the encoding of the prefix is that of the prefix without that
token, followed by it. A token can be last if it is a suffix of the prefix and is compatible with the last token of what is
left: no merge over the seam of the two would have come first. A suffix automaton of the vocabulary, fed symbol by symbol,
lists the tokens that end at each place, longest first; the first compatible one is stored; back-pointers give the ids.

Texts are normalised and split as the file says: NFC, white space, lower case, then the split pattern. Python does this for
characters whose classes are the same in all Unicode versions; a text with any other is normalised and split by the library's
own components, whole, so the ids are the same as the library's for every text. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Sequence
from copy import copy
from functools import lru_cache
from operator import itemgetter

import numpy as np
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.shared import map_batches

#: Words and pairs that a worker remembers at most, beside those of one batch.
REMEMBER = 1 << 20
#: Words that the tokenizers library encodes at once.
WORDS = 4096
#: White space to Python's patterns, but not to the library's.
ODD_SPACES = re.compile("[\x1c-\x1f]")
#: Characters that Python, its regex module and the library class alike (a test compares them one by one).
COMMON = regex.compile(r"[\x00-\x1b\x20-\u017fΑ-ΡΣ-ϼЀ-ҁҊ-ԯ\u2010-\u2027\u2030-\u205e₠-₿ぁ-ゖァ-ヺ一-龥가-힣]*+")
#: Fixed value: the split pattern that has a faster equal for texts of common characters.
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=1)
def _common_split() -> re.Pattern:
    """KNOWN_SPLIT with the classes written out for common characters, and letters, the most frequent, tried first (no other branch starts with one)."""

    def ranges(of: str) -> str:
        inside, found = regex.compile(of), []
        for c in range(0xD800):  # COMMON has no characters beyond
            if COMMON.fullmatch(chr(c)) and inside.match(chr(c)):
                if found and found[-1][1] == c - 1:
                    found[-1][1] = c
                else:
                    found.append([c, c])
        return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in found)

    letters, numbers = ranges(r"\p{L}"), ranges(r"\p{N}")
    return re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^\s{letters}{numbers}]+")


def _common(text: str) -> bool:
    """Are all characters common? Latin-1, all of it common but for four controls, is tried first."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(COMMON.fullmatch(text))
    return not ODD_SPACES.search(text)


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones for themselves, the rest from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class SuffixAutomaton:
    """Of a set of words over numbers below 512: after each symbol it knows the longest suffix read that is part of any word."""

    def __init__(self, words: Iterable[tuple[int, tuple[int, ...]]]):
        follow: list[dict[int, int]] = [{}]
        link, length = [-1], [0]

        def copy_of(state: int, size: int) -> int:
            follow.append(dict(follow[state]))
            link.append(link[state])
            length.append(size)
            link[state] = len(link) - 1
            return len(link) - 1

        def redirect(state: int, symbol: int, old: int, new: int) -> None:
            while state >= 0 and follow[state].get(symbol) == old:
                follow[state][symbol] = new
                state = link[state]

        def extend(last: int, symbol: int) -> int:
            there = follow[last].get(symbol)
            if there is not None:
                if length[there] == length[last] + 1:
                    return there
                new = copy_of(there, length[last] + 1)
                redirect(last, symbol, there, new)
                return new
            follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            new, state = len(link) - 1, last
            while state >= 0 and symbol not in follow[state]:
                follow[state][symbol] = new
                state = link[state]
            if state >= 0:
                there = follow[state][symbol]
                if length[there] != length[state] + 1:
                    split = copy_of(there, length[state] + 1)
                    redirect(state, symbol, there, split)
                    there = split
                link[new] = there
            return new

        ends: dict[int, list[tuple[int, int]]] = {}
        for word_id, word in words:
            state = 0
            for symbol in word:
                state = extend(state, symbol)
            ends.setdefault(state, []).append((len(word), word_id))
        # A state may have been split after a word ended in it: what is no longer than the link's strings moves up.
        self.own: dict[int, tuple[tuple[int, int], ...]] = {}
        for state, found in ends.items():
            for size, word_id in found:
                at = state
                while size <= length[link[at]]:
                    at = link[at]
                self.own[at] = (*self.own.get(at, ()), (size, word_id))
        self.own = {s: tuple(sorted(x, reverse=True)) for s, x in self.own.items()}
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        self.keys = np.fromiter((s << 9 | c for s, d in enumerate(follow) for c in d), np.int64)
        self.targets = np.fromiter((t for d in follow for t in d.values()), np.int32, len(self.keys))


class Vocabulary:
    """What a tokenizer file says, and the automaton. Made once on the driver; its size is that of the file.

    Without whole, what only the dynamic program needs (ranks, spines, the automaton) is left out: it takes most of the memory.
    """

    def __init__(self, text: str, whole: bool = True):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("only byte-level BPE vocabularies without a decoder are supported")
        self.text, self.vocab, self.suffix = text, model["vocab"], model.get("end_of_word_suffix") or ""
        letters = _byte_letters()
        self.base = [self.vocab[x] for x in letters] + [self.vocab[x + self.suffix] for x in letters]
        self.names = {i: t for t, i in self.vocab.items()} | {a["id"]: a["content"] for a in spec.get("added_tokens", [])}
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec.get("added_tokens", [])):
            raise ValueError("added tokens with rules of their own aren't supported")
        steps = spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("the normalizer isn't supported")
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = dict.fromkeys(self.base, -1)
        spelled = {i: (s,) for s, i in enumerate(self.base)}
        for r, (a, b) in enumerate(model["merges"]):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if z in self.parts or max(self.born[x], self.born[y]) >= r:
                raise ValueError("merges must make each token once, after its parts")
            self.rank[x, y], self.parts[z], self.born[z] = r, (x, y), r
            if whole:
                spelled[z] = spelled[x] + spelled[y]
        if not whole:
            self._lighten()
            return
        self._spines()
        kept = set(self.base)
        for z, (x, y) in self.parts.items():  # in the order of ranks: parts first
            if x in kept and y in kept and not self._earlier(x, y, self.born[z]):
                kept.add(z)
        self.automaton = SuffixAutomaton((i, spelled[i]) for i in sorted(kept))

    def _lighten(self) -> None:
        self.automaton = None
        self.rank, self.parts, self.born, self.right, self.left, self.vocab = {}, {}, {}, {}, {}, {}

    def _spines(self) -> None:
        """Of each token: it, its last part, that one's last part ... with the rank at which each goes into a larger one; likewise first parts."""
        self.right: dict[int, tuple] = {}
        self.left: dict[int, tuple] = {}
        for i in self.born:
            self.right[i] = ((i, None),) if i not in self.parts else ((i, None), *((j, self.born[i] if r is None else r) for j, r in self.right[self.parts[i][1]]))
            self.left[i] = ((i, None),) if i not in self.parts else ((i, None), *((j, self.born[i] if r is None else r) for j, r in self.left[self.parts[i][0]]))

    def _earlier(self, x: int, y: int, until: int | None = None) -> bool:
        """Would a merge over the seam between x and y come before both are whole (or, with until, before that rank)? Of merges of one rank the leftmost is first."""
        rank, end = self.rank, 1 << 60 if until is None else until
        for a, ra in self.right[x]:
            ra = end if ra is None else ra
            for b, rb in self.left[y]:
                m = rank.get((a, b))
                if m is not None and m < ra and (m < end if rb is None else m <= rb):
                    return True
        return False


class Encoder:
    """Encodes batches of texts. form makes what is remembered of a word's ids, and join puts such pieces together.

    Texts are split into words; the words of a batch that aren't remembered are encoded in sorted order, so a prefix that they
    share is worked out once; then texts are joined from the words' pieces. What is remembered is bounded: over REMEMBER
    entries, only those of the present batch stay.
    """

    remember = REMEMBER

    def __init__(self, vocabulary: Vocabulary, form: Callable[[list[int]], object] = tuple, join: Callable[[Iterable], object] | None = None):
        v = self.v = vocabulary
        self.form, self.join = form, join or (lambda pieces: [i for p in pieces for i in p])
        if v.automaton is not None:
            self.follow = dict(zip(v.automaton.keys.tolist(), v.automaton.targets.tolist(), strict=True))
            self.link, self.length = v.automaton.link.tolist(), v.automaton.length.tolist()
        self.lists: dict[int, tuple] = {0: ()}
        self.pairs: dict[int, bool] = {}
        self.words = _common_split() if v.pattern == KNOWN_SPLIT else regex.compile(v.pattern)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(v.added, key=len, reverse=True))) + ")") if v.added else None
        self.pieces: dict[str, object] = {}
        self.library = None

    def _ending(self, state: int) -> tuple:
        """(length, token) of the tokens that are suffixes of the longest string of a state, longest first."""
        found = self.lists.get(state)
        if found is None:
            found = self.lists[state] = self.v.automaton.own.get(state, ()) + self._ending(self.link[state])
        return found

    def _compatible(self, left: int, right: int) -> bool:
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= REMEMBER:
                self.pairs.clear()
            found = self.pairs[key] = not self.v._earlier(left, right)
        return found

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of each word, by dynamic programming over prefixes; last and back are those of the prefixes of the word before, as far as they are the same."""
        follow, link, length, lists, pairs, ending, compatible = self.follow, self.link, self.length, self.lists, self.pairs, self._ending, self._compatible
        out: dict[str, list[int]] = {}
        states, known, last, back = [0], [0], [-1], [0]
        before = b""
        for raw, word in sorted((w.encode(), w) for w in words):
            n = len(raw)
            same, most = 0, min(n, len(before)) - 1
            while same < most and raw[same] == before[same]:
                same += 1
            del states[same + 1 :], known[same + 1 :], last[same + 1 :], back[same + 1 :]
            before, state, size_known = raw, states[same], known[same]
            for end in range(same + 1, n + 1):
                symbol = raw[end - 1] if end < n else raw[end - 1] + 256
                while (there := follow.get(state << 9 | symbol)) is None:
                    state = link[state]
                    size_known = length[state]
                state = there
                size_known += 1
                found = lists.get(state)
                for size, token in ending(state) if found is None else found:
                    if size <= size_known:
                        if size == end:
                            break
                        left = last[end - size]
                        good = pairs.get(left << 20 | token)
                        if compatible(left, token) if good is None else good:
                            break
                else:
                    raise AssertionError(f"no last token for a prefix of {word!r}")
                states.append(state)
                known.append(size_known)
                last.append(token)
                back.append(end - size)
            ids, end = [], n
            while end:
                ids.append(last[end])
                end = back[end]
            out[word] = ids[::-1]
        return out

    def split(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if _common(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            return self.words.findall(text.lower())
        if self.library is None:
            from tokenizers import Regex, Tokenizer
            from tokenizers.pre_tokenizers import Split

            self.library = Tokenizer.from_str(self.v.text).normalizer, Split(Regex(self.v.pattern), "removed", invert=True)
        normal, splitter = self.library
        return [w for w, _ in splitter.pre_tokenize_str(normal.normalize_str(text))]

    def _split_with_added(self, text: str) -> list[str]:
        """A text's words; an added token is one of its own, marked by a space in front."""
        if self.special is None or not any(t in text for t in self.v.added):
            return self.split(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [" " + part] if i % 2 else self.split(part)
        return out

    def encode_batch(self, texts: Sequence[str | None]) -> list:
        split = [self._split_with_added(t or "") for t in texts]
        present = set().union(*split)
        if len(self.pieces) + len(present) > self.remember:
            self.pieces = {w: self.pieces[w] for w in present if w in self.pieces}
        new = present.difference(self.pieces)
        self.pieces |= {w: self.form([self.v.added[w[1:]]]) for w in new if w[0] == " "}
        self.pieces |= {w: self.form(ids) for w, ids in self.encode_words(w for w in new if w[0] != " ").items()}
        piece = self.pieces.__getitem__
        return [self.join(map(piece, words)) for words in split]

    def encode(self, text: str | None) -> list[int]:
        return list(self.encode_batch([text])[0])

    def decode(self, ids: Iterable[int]) -> str:
        """The file has no decoder: tokens as they are written, joined by spaces."""
        return " ".join(map(self.v.names.__getitem__, ids))


class LibraryEncoder(Encoder):
    """The same to bytes of little-endian ids, with the words' ids from the tokenizers library, for those who need ids and not the method; a light vocabulary will do.

    Texts are cut at white space, which is in no word, and what is between is remembered whole, so only what is new is split into
    words. The library gets WORDS words as one text and no threads of its own: a task has the core that Spark gave it. Words are
    told apart by the suffix of their last tokens, or one by one where the vocabulary has none.
    """

    remember = REMEMBER >> 1

    def __init__(self, vocabulary: Vocabulary, kind: str):
        super().__init__(vocabulary, None, b"".join)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.kind = np.dtype(kind)
        self.whole = Tokenizer.from_str(vocabulary.text)
        self.whole.normalizer = normalizers.Sequence([])  # words are normal and split already
        self.whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.whole.encode_special_tokens = True
        self.letters = vocabulary.pattern == KNOWN_SPLIT  # letters in a row are one word
        self.words_and_spaces = (re if self.letters else regex).compile(f"{self.words.pattern}| ")
        self.last = np.zeros(max(vocabulary.names) + 1, bool)
        if vocabulary.suffix:
            self.last[[i for i, t in vocabulary.names.items() if t.endswith(vocabulary.suffix)]] = True

    def packed_words(self, words: Iterable[str]) -> dict[str, bytes]:
        listed, size, out = list(words), self.kind.itemsize, {}
        for at in range(0, len(listed), WORDS):
            some = listed[at : at + WORDS]
            ids = np.array(self.whole.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            ends = (np.flatnonzero(self.last[ids]) + 1) * size
            if len(ends) != len(some):  # each word has one at least, its last
                found = [e.ids for e in self.whole.encode_batch_fast(some, add_special_tokens=False)]
                ids, ends = np.concatenate([np.array(x, np.int64) for x in found]), np.cumsum([len(x) * size for x in found])
            data, ends = ids.astype(self.kind).tobytes(), ends.tolist()
            out.update((w, data[a:b]) for w, a, b in zip(some, [0, *ends[:-1]], ends, strict=True))
        return out

    def encode_batch(self, texts: Sequence[str | None]) -> list[bytes]:
        split, whole = [], set()
        for text in texts:
            text = text or ""
            if not _common(text) or any(t in text for t in self.v.added):
                split.append(self._split_with_added(text))
                whole.update(split[-1])  # words of texts that aren't common, and added tokens
            else:
                if not text.isascii():
                    text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
                split.append(text.lower().split())
        present = set().union(*split)
        new = present.difference(self.pieces)
        mixed = [c for c in new if c not in whole and not (self.letters and c.isalpha())]
        parts = self.words_and_spaces.findall(" ".join(mixed) + " ")  # one flat list: as many small ones wake the garbage collector
        if len(self.pieces) + 2 * len(new) > self.remember:
            self.pieces = {c: self.pieces[c] for c in present if c in self.pieces}
        words = new.difference(mixed).union(parts).difference(self.pieces, " ")
        added = {w for w in words if w[0] == " "}
        self.pieces.update((w, np.array([self.v.added[w[1:]]], self.kind).tobytes()) for w in added)
        self.pieces |= self.packed_words(words - added)
        piece, following = self.pieces.__getitem__, iter(parts).__next__
        self.pieces |= [(c, b"".join(map(piece, iter(following, " ")))) for c in mixed]
        return [b"".join(itemgetter(*chunks)(self.pieces) if len(chunks) > 1 else map(piece, chunks)) for chunks in split]


def library_packed(vocabulary: Vocabulary, kind: str = "<u4") -> LibraryEncoder:
    return LibraryEncoder(vocabulary, kind)


def packed(vocabulary: Vocabulary, kind: str = "<u4") -> Encoder:
    """An encoder to bytes of little-endian ids."""
    code = {"<u2": "H", "<u4": "I"}[kind]
    return Encoder(vocabulary, lambda ids: array(code, ids).tobytes(), b"".join)


def written(vocabulary: Vocabulary) -> Encoder:
    """An encoder to decimal ids joined by spaces."""
    return Encoder(vocabulary, lambda ids: " ".join(map(str, ids)), " ".join)


@lru_cache(maxsize=4)
def vocabulary(path: str, whole: bool = True) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read(), whole)


_encoders: dict[tuple, Encoder] = {}


def encoder(shared: Broadcast, make: Callable[..., Encoder], *options) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; made once a worker."""
    key, v = shared.value
    key = (key, make.__name__, *options)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = make(v, *options)
    return _encoders[key]


def forget_encoders() -> None:
    """Free the memory of a worker that has no more texts to encode."""
    _encoders.clear()


def light(v: Vocabulary) -> Vocabulary:
    """Without what the dynamic program needs."""
    out = copy(v)
    out._lighten()
    return out


def share(spark: SparkSession, path: str, whole: bool = True) -> Broadcast:
    """The vocabulary for the workers; its size is bounded by the file's, a few MB."""
    v = vocabulary(path, whole)
    return spark.sparkContext.broadcast((hashlib.sha256(v.text.encode()).hexdigest(), v))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (decimal, joined by one space) and decoded, for each row of docs."""
    shared, kind = share(docs.sparkSession, path), docs.schema[id_col].dataType.simpleString()

    def make():
        e = encoder(shared, written)
        names = {str(i): t for i, t in e.v.names.items()}

        def one(batch):
            ids = e.encode_batch(batch.column(1).to_pylist())
            return {id_col: batch.column(0), "ids": ids, "decoded": [" ".join(map(names.__getitem__, x.split())) for x in ids]}

        return one

    return map_batches(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")), make, f"`{id_col}` {kind}, ids string, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    ids = F.col("ids")
    count = F.when(ids == "", F.lit(0)).otherwise(F.length(ids) - F.length(F.replace(ids, F.lit(" "), F.lit(""))) + 1)
    return encoded.select(id_col, count.cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
