"""Operator 3: exact token counts of every prefix, by prefix dynamic programming over a piece model with byte fallback.

The model marks each space by U+2581, which its pieces have at their start only, and has no piece across a line feed; so a normalised text is
cut there into words, each with the run of spaces before it, whose counts add up. Within a word, ``last[i]`` is the last token of the encoding of the first ``i`` characters: the one
piece that ends at ``i`` and that the merges leave apart from ``last[i - its length]``. Then ``count[i] = count[i - its length] + 1``. As every
prefix has its count, a text's token count, the longest prefix within a budget and the counts at any cuts are look-ups, without encoding again.

Null and empty texts have no tokens; an empty table gives an empty one. Texts of any length are counted whole, word by word. Repeated rows give repeated rows,
null ids stay, and other columns aren't read, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table, tokenizer_path

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
#: Words and pairs of tokens that a worker remembers; beyond it a memory starts anew, so that a worker's memory is bounded.
REMEMBER = 400_000
#: Characters of a word up to which it is remembered.
LONG = 48

_words = re.compile(rf"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*").findall


class PrefixCounter:
    """Counts for one model; one for each Python worker."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec, rule = proto.trainer_spec, proto.normalizer_spec
        normal = [p for p in proto.pieces if p.type == 1]
        if spec.model_type != 2 or not spec.byte_fallback or rule.name != "identity" or rule.remove_extra_whitespaces or not (rule.add_dummy_prefix and rule.escape_whitespaces) or spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, an identity normaliser and a dummy prefix are counted")
        if any(SPACE in p.piece.lstrip(SPACE) or "\n" in p.piece for p in normal) or any(p.type not in (1, 2, 3, 6) for p in proto.pieces):
            raise ValueError("a piece of this model crosses a word")
        #: The merge of a pair comes the earlier, the higher its piece's score.
        self.score = {p.piece: p.score for p in normal}
        #: By the last two characters of a prefix, the lengths of pieces that end so.
        self.lengths: dict[str, tuple[int, ...]] = {}
        for x in sorted(self.score, key=len, reverse=True):
            if len(x) > 1 and len(x) not in (known := self.lengths.get(x[-2:], ())):
                self.lengths[x[-2:]] = *known, len(x)
        self.lengths = {k: (*v, 1) for k, v in self.lengths.items()}
        self.kept: dict[str, tuple[int, str]] = {"": (0, "")}
        self.together = lru_cache(REMEMBER)(self._together)
        outer = self

        class Words(dict):
            def __missing__(self, word):
                if len(word) > LONG:
                    return outer.prefixes(outer.symbols(word))[-1]
                if len(self) >= REMEMBER:
                    self.clear()
                n = self[word] = outer.total(outer.symbols(word))
                return n

        self.words = Words()
        del sentencepiece

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves of a text: always the pair with the highest score, the leftmost of equals."""
        part, after, before = [*text], [*range(1, len(text) + 1)], [*range(-1, len(text) - 1)]
        heap: list[tuple] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(part) and (s := self.score.get(x := part[i] + part[after[i]])) is not None:
                heapq.heappush(heap, (-s, i, x))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, x = heapq.heappop(heap)
            if not part[i] or after[i] >= len(part) or part[i] + part[after[i]] != x:
                continue
            j = after[i]
            part[i], part[j], after[i] = x, "", after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in part if x]

    def _together(self, a: str, b: str) -> bool:
        """True if merging leaves these two pieces apart, so that one can follow the other in an encoding."""
        return self.merged(a + b) == [a, b]

    def step(self, word: str, i: int, at: Callable[[int], tuple[int, str]]) -> tuple[int, str]:
        """Count and last token of the first ``i`` characters; ``at(j)`` gives them for fewer."""
        for n in self.lengths.get(word[max(0, i - 2) : i], (1,)):
            if (j := i - n) < 0 or (piece := word[j:i]) not in self.score:
                continue
            if j == 0:
                return 1, piece
            count, last = at(j)
            if self.together(last, piece):
                return count + 1, piece
        return at(i - 1)[0] + len(word[i - 1].encode()), word[i - 1]  # no piece for this character: its bytes; merges stop there

    def prefixes(self, word: str) -> list[int]:
        """The count at every prefix of a word whose spaces are marked, that of no characters first."""
        states = [(0, "")]
        for i in range(1, len(word) + 1):
            states.append(self.step(word, i, states.__getitem__))
        return [n for n, _ in states]

    def total(self, word: str) -> int:
        """The count of a whole short word; its prefixes' counts are kept, and are there for other words that begin alike."""
        kept = self.kept
        if len(kept) > REMEMBER:
            kept.clear()
            kept[""] = 0, ""
        i = len(word)
        while word[:i] not in kept:
            i -= 1
        for k in range(i + 1, len(word) + 1):
            kept[word[:k]] = self.step(word, k, lambda j: kept[word[:j]])
        return kept[word][0]

    @staticmethod
    def symbols(word: str) -> str:
        """A word as ``split`` gives it, with its space marked; one that begins a line has none."""
        return word if word[:1] == "\n" else SPACE + word

    @staticmethod
    def split(text: str | None) -> list[str]:
        """The words of a text without their first space, as ``symbols`` takes them; a line feed begins a word of its own that has none."""
        if not text:
            return []
        if text[0] == " " or "  " in text or SPACE in text:
            return [x if x[0] == "\n" else x[1:] for x in _words(SPACE + text.replace(" ", SPACE))]
        return text.replace("\n", " \n").split(" ")

    def count(self, text: str | None) -> int:
        return sum(map(self.words.__getitem__, self.split(text)))

    def table(self, text: str | None) -> list[int]:
        """The count at every prefix of the normalised text, whose first character is the mark of the space put before it."""
        out = [0]
        for word in self.split(text):
            base = out[-1]
            out += [base + n for n in self.prefixes(self.symbols(word))[1:]]
        return out

    def cut(self, text: str | None, budget: int) -> str:
        """The longest prefix of the normalised text that has ``budget`` tokens at most."""
        counts = self.table(text)
        best = list(accumulate(reversed(counts), min))[::-1]  # the least count here or later
        end = bisect_right(best, budget) - 1
        return "".join(map(self.symbols, self.split(text)))[:end].replace(SPACE, " ")[1:]


_counters: dict[str, PrefixCounter] = {}


def counter(model_file: str) -> PrefixCounter:
    if model_file not in _counters:
        _counters[model_file] = PrefixCounter(model_file)
    return _counters[model_file]


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, model_file: str | None = None) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of each row; repeated rows give repeated rows."""
    path = model_file or tokenizer_path(MODEL)

    def make():
        c = counter(path)
        return lambda texts: [(len((t or "").encode()), n := c.count(t), n > limit) for t in texts]

    return map_texts(df, make, "n_bytes bigint, n_tokens bigint, over_limit boolean", key, text)


def prefix_counts(df: DataFrame, key: str = "doc_id", text: str = "text", model_file: str | None = None) -> DataFrame:
    """``key`` and ``counts``: the token count at every prefix of the normalised text."""
    path = model_file or tokenizer_path(MODEL)
    return map_texts(df, lambda: lambda texts: [(counter(path).table(t),) for t in texts], "counts array<int>", key, text, rows=32)


def truncate(df: DataFrame, budget: int, key: str = "doc_id", text: str = "text", model_file: str | None = None) -> DataFrame:
    """``key`` and ``text``, cut to the longest prefix with at most ``budget`` tokens."""
    path = model_file or tokenizer_path(MODEL)
    return map_texts(df, lambda: lambda texts: [(counter(path).cut(t, budget),) for t in texts], f"`{text}` string", key, text)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
