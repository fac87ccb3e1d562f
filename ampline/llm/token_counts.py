"""Token counts by a compiled finite-state transducer.

Inside a pre-token the byte-pair merges are compiled to a deterministic transducer: a state is what the encodings of
the prefixes that a later token can still follow end in, and each transition carries the number of tokens by which the encoding grows (negative
where a merge swallows earlier tokens). States and transitions are compiled when first met. White space sends every
state back to the start, so the state map of a chunk of text is (text before its first white space, tokens between,
text after its last white space); such maps compose associatively, and a long text is cut into chunks whose maps are
combined by a parallel prefix scan.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
#: Bounds of a worker's caches: whole runs, and compiled transitions.
MAX_RUNS, MAX_ARCS = 600_000, 600_000

# The settings of a vocabulary file that can be compiled, and the white space of Unicode.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def settings(spec: dict) -> tuple[list[str], str]:
    """Special tokens and split pattern of a vocabulary file; what can't be compiled is refused."""

    def must(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(f"this vocabulary can't be compiled: {what}")

    model, pre = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    for k, v in MODEL.items():
        must((model.get(k) or None) == (v or None), f"model {k} is {model.get(k)!r}")
    must((spec.get("normalizer") or {}).get("normalizers") == NORMALIZER, "its normalizer")
    split = pre[0]
    must(len(pre) == 2 and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True and "Regex" in split.get("pattern", {}), "its splitting")
    must({k: pre[-1].get(k) for k in BYTES} == BYTES, "its byte level")
    added = spec.get("added_tokens") or []
    must(not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")), "its added tokens")
    return [t["content"] for t in added], split["pattern"]["Regex"]


class ChunkMap(NamedTuple):
    """State map of a chunk. sync: it holds white space; head and tail: the unfinished runs at its ends."""

    sync: bool
    head: str
    count: int
    tail: str


class Transducer:
    """A lower-casing word-level BPE vocabulary (with an end-of-word suffix) as a lazily compiled transducer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special, pattern = settings(spec)
        model = spec["model"]
        self.vocab = model["vocab"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.made: dict[str, tuple[int, str, str]] = {}  # a token's merge: rank, left, right
        for i, (a, b) in enumerate(merges):
            self.made.setdefault(a + b, (i, a, b))
        bodies = (v.removesuffix(END) for v in self.vocab)
        self.begun = {""}.union(b[:i] for b in bodies for i in range(1, len(b)))  # what can go on to a token
        self.bytes = byte_symbols()
        self.split = regex.compile(pattern.replace(r"\s", SPACE))
        self.odd = regex.compile("[\x1c-\x1f]")
        self.space = regex.compile(f"[{SPACE}]+")
        # the longest first, where one begins another
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.marks = [t[:2] for t in special]
        self.own: dict[str, bool] = {}
        self.reset()
        self.runs = _Runs(self)

    def reset(self) -> None:
        """Forget compiled states; they are compiled again when met."""
        self.states: list[tuple[tuple[str, str, int], ...]] = [(("", "", 0),)]
        self.ids: dict[tuple, int] = {self.states[0]: 0}
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]  # of each state: symbol to next state and count
        self.n_arcs = 0

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges applied by rank: the definition that the transducer is compiled from."""
        while len(symbols) > 1:
            best, at = min((self.rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if best == 1 << 30:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def symbols(self, token: str) -> list[str]:
        body = token.removesuffix(END)
        return [*body[:-1], body[-1] + END] if token.endswith(END) and body else list(body)

    def whole(self, token: str) -> bool:
        """Whether a word that spells this token is encoded as this token."""
        ok = self.own.get(token)
        if ok is None:
            ok = self.own[token] = self.merged(self.symbols(token)) == [token]
        return ok

    def fits(self, before: str, token: str) -> bool:
        """Whether two tokens may stand side by side: undoing merges from the later one on, none joins across the border sooner."""
        limit = 1 << 30
        while True:
            if self.rank.get((before, token), 1 << 30) < limit:
                return False
            left, right = self.made.get(before), self.made.get(token)
            if left and (not right or left[0] > right[0]):
                limit, before = left[0], left[2]
            elif right:
                limit, token = right[0] + 1, right[1]
            else:
                return True

    def arc(self, state: int, symbol: str) -> tuple[int, int]:
        """Next state and tokens by which the encoding grows, for one more symbol; compiles the transition.

        A state holds, for each place at which a token still unfinished may have begun, what of that token is read, the
        last token of the encoding up to there ("" at a word's start), and that encoding's count against the present
        one. The last token of a longer prefix is the one that is whole and fits the last token of what precedes it.
        Words that differ in nothing that a later token can depend on share their states.
        """
        places = self.states[state]
        for read, before, count in places:
            token = read + symbol
            if token in self.vocab and self.whole(token) and (not before or self.fits(before, token)):
                delta = 1 + count
                break
        else:
            raise ValueError(f"the vocabulary lacks a symbol of {places[0][0] + symbol!r}")
        nxt = 0
        if len(symbol) == 1:  # else the word is over, and no state is needed
            open_ones = [(more, before, count - delta) for read, before, count in places if (more := read + symbol) in self.begun]
            key = (*open_ones, ("", token, 0))
            nxt = self.ids.setdefault(key, len(self.states))
            if nxt == len(self.states):
                self.states.append(key)
                self.arcs.append({})
        self.n_arcs += 1
        hit = self.arcs[state][symbol] = (nxt, delta)
        return hit

    def word(self, pretoken: str) -> int:
        """Tokens of one pre-token."""
        if self.n_arcs > MAX_ARCS:
            self.reset()
        symbols = [self.bytes[b] for b in pretoken.encode()]
        symbols[-1] += END
        arcs = self.arcs
        state = total = 0
        for s in symbols:
            hit = arcs[state].get(s)
            state, delta = hit if hit is not None else self.arc(state, s)
            total += delta
        return total

    def run(self, text: str) -> int:
        """Tokens of a run without white space, which may hold special tokens."""
        if self.special and any(m in text for m in self.marks) and len(parts := self.special.split(text)) > 1:
            return sum(1 if i % 2 else self.plain(p) for i, p in enumerate(parts))
        return self.plain(text)

    def plain(self, text: str) -> int:
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return sum(map(self.word, self.split.findall(text)))

    def pieces(self, text: str) -> list[str]:
        return text.split() if not self.odd.search(text) else [p for p in self.space.split(text) if p]

    def chunk(self, text: str) -> ChunkMap:
        """State map of a chunk."""
        first = self.space.search(text)
        if not first:
            return ChunkMap(False, text, 0, "")
        runs = self.pieces(text[first.end() :])
        tail = runs.pop() if runs and not self.space.match(text[-1]) else ""
        return ChunkMap(True, text[: first.start()], self.total(runs), tail)

    def total(self, runs: list[str]) -> int:
        return sum(map(self.runs.__getitem__, runs))

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """Map of a's chunk followed by b's; associative."""
        if not a.sync and not b.sync:
            return ChunkMap(False, a.head + b.head, 0, "")
        if not a.sync:
            return ChunkMap(True, a.head + b.head, b.count, b.tail)
        if not b.sync:
            return ChunkMap(True, a.head, a.count, a.tail + b.head)
        return ChunkMap(True, a.head, a.count + self.total([a.tail + b.head] if a.tail or b.head else []) + b.count, b.tail)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """All prefix compositions, in a logarithmic number of rounds of independent compositions."""
        step = 1
        while step < len(maps):
            maps = [m if i < step else self.compose(maps[i - step], m) for i, m in enumerate(maps)]
            step *= 2
        return maps

    def fold(self, maps: list[ChunkMap]) -> ChunkMap:
        """The last prefix composition alone: the scan's up-sweep."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text."""
        if len(text) <= chunk:
            return self.total(self.pieces(text))
        whole = self.fold([self.chunk(text[i : i + chunk]) for i in range(0, len(text), chunk)])
        return whole.count + sum(self.run(t) for t in ((whole.head, whole.tail) if whole.sync else (whole.head,)) if t)


class _Runs(dict):
    """Counts of runs seen before: paths through the transducer contracted to one transition."""

    def __init__(self, owner: Transducer):
        super().__init__()
        self.owner = owner

    def __missing__(self, run: str) -> int:
        n = self.owner.run(run)
        if len(run) <= 64:
            if len(self) >= MAX_RUNS:
                self.clear()
            self[run] = n
        return n


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(df: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens", chunk: int = CHUNK) -> DataFrame:
    """Add a column with the number of tokens of each whole text under a word-level BPE vocabulary file.

    path must be readable on every executor (a file of an installed package). Files with another normalizer, splitting or
    model than those that are compiled here raise an error. Null and empty texts have 0 tokens;
    special strings inside a text count as one token each; repeated rows are counted alike. A column that is already
    named out is replaced; other columns pass through. No shuffle; memory is bounded by one Arrow batch and the caches.
    """

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        t = transducer(path)
        return pd.Series([t.count(x, chunk) if x else 0 for x in texts], dtype="int64")

    return df.withColumn(out, counted(F.col(text_col)))
