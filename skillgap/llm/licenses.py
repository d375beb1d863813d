"""License scans: every text block that holds a template's words in order, and fixed phrases with their places.

Words are runs of letters and digits, A-Z lower-cased; everything beyond ASCII
counts as a letter. A token is ``GRAM`` words in a row (a shorter template is one token), so
that word order counts. A block is a line, or a window over the words of the whole
text with line ends ignored. Windows have the smallest power of two that is at least
twice a template's words (``LEAST_WINDOW`` at least), and each begins half a window after the
one before, so a statement wrapped anywhere lies whole in one of them; a window that begins in the
last half of the one before and ends with it is left out.

A block matches a template if it holds at least ``threshold`` of the template's
distinct tokens. The join is exact. Tokens are put in one order for the whole
corpus, rarest first, by the number of documents that hold them. A matching
block must hold one of the template's first ``size - ceil(threshold * size) + 1``
tokens (prefix filter), must have enough places for tokens (length filter), and
from the first of them that it holds on, must have enough template tokens in
corpus order (positional filter); what is left is counted in full.

Templates of one family share most of their words. Tokens that no other label of the
family has tell a template apart: it matches only where the threshold holds for these as well. Where
blocks of several labels of a family still overlap, the largest containment stays,
and of equal ones that with the most tokens.

Templates and phrases go to every task, so their text is held to ``MOST_TEMPLATES`` bytes.
Null and empty texts have no words and no labels. Repeated rows and null keys
give a row each; other columns are left out.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgap.llm.lexical import terms as words_of
from skillgap.llm.license_texts import NOTICES, PHRASES, STATEMENTS, Template

TEMPLATES: tuple[Template, ...] = NOTICES + STATEMENTS
GRAM = 3
LEAST_WINDOW = 16
MOST_TEMPLATES = 4_000_000
Token = tuple[bytes, ...]


def tokens_of(words: Sequence[bytes]) -> list[Token]:
    """The tokens of a template, in text order."""
    n = min(GRAM, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if n else []


def window_of(words: int) -> int:
    """Words of the windows for a template of so many words."""
    return max(LEAST_WINDOW, 1 << (2 * words - 1).bit_length())


class Finder:
    """Places of known tokens in a list of words, found by each token's longest word."""

    def __init__(self, known: Mapping[Token, int]):
        self.known = known
        #: Word to where in a token it stands, and how many words that has.
        self.by_word: dict[bytes, set[tuple[int, int]]] = {}
        for token in known:
            at = max(range(len(token)), key=lambda i: (len(token[i]), token[i]))
            self.by_word.setdefault(token[at], set()).add((at, len(token)))
        self.words = frozenset(self.by_word)

    def find(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(place, number) of each occurrence, in order."""
        found = set()
        for word in self.words.intersection(words):
            at = -1
            for _ in range(words.count(word)):
                at = words.index(word, at + 1)
                for before, n in self.by_word[word]:
                    if at >= before:
                        number = self.known.get(tuple(words[at - before : at - before + n]))
                        if number is not None:
                            found.add((at - before, number))
        return sorted(found)


class Index:
    """Templates with their tokens in corpus order, found by the tokens of their prefixes."""

    def __init__(self, templates: Sequence[Template], counts: Mapping[Token, int], threshold: float):
        held = [(t, tokens_of(words_of(t.text)), len(words_of(t.text))) for t in templates]
        held = [x for x in held if x[1]]
        order = sorted({token for _, tokens, _ in held for token in tokens}, key=lambda k: (counts.get(k, 0), k))
        self.number = {token: i for i, token in enumerate(order)}
        self.size = [len(token) for token in order]
        #: (label, family, tokens in order, how many are needed, tokens that tell apart, how many of these, window)
        self.templates: list[tuple[str, str, list[int], int, frozenset[int], int, int]] = []
        self.by_token: dict[int, list[tuple[int, int]]] = {}
        for t, tokens, n_words in held:
            own = sorted({self.number[k] for k in tokens})
            rivals = {self.number[k] for o, others, _ in held for k in others if t.family and o.family == t.family and o.label != t.label}
            telling = frozenset(own) - rivals
            need = max(1, math.ceil(threshold * len(own) - 1e-9))
            for at, token in enumerate(own[: len(own) - need + 1]):
                self.by_token.setdefault(token, []).append((len(self.templates), at))
            family = t.family or t.label
            self.templates.append((t.label, family, own, need, telling, math.ceil(threshold * len(telling) - 1e-9), window_of(n_words)))

    def candidates(self, block: Sequence[int], places: int) -> Iterator[int]:
        """Templates that no filter rejects, for a block's tokens in corpus order and its places for tokens."""
        first: dict[int, int] = {}
        left = {token: len(block) - i for i, token in enumerate(block)}
        for token in block:
            for template, at in self.by_token.get(token, ()):
                first[template] = min(at, first.get(template, at))
        for template, at in first.items():
            own, need = self.templates[template][2:4]
            if places >= need and left[own[at]] >= need:
                yield template

    def match(self, template: int, block: set[int]) -> float:
        """The containment, 0 if it is no match."""
        _, _, own, need, telling, need_telling, _ = self.templates[template]
        held = sum(token in block for token in own)
        if held < need or sum(token in block for token in telling) < need_telling:
            return 0.0
        return held / len(own)


def _lines(text: str) -> list[int]:
    """Where in the text's words each line begins, and where the last ends."""
    out = [0]
    for line in text.split("\n"):
        out.append(out[-1] + len(words_of(line)))
    return out


#: Blocks of more words are held against all others; few are as long.
_LONG = 2048


def _best(found: dict[tuple[str, str, int, int], tuple[float, int]]) -> list[tuple[str, int, int, float]]:
    """Of overlapping blocks of one family the best label: largest containment, then most tokens."""
    out = []
    families: dict[str, list[tuple]] = {}
    for (label, family, first, end), held in found.items():
        families.setdefault(family, []).append((first, end, label, held))
    for blocks in families.values():
        if len({label for _, _, label, _ in blocks}) > 1:
            blocks.sort()
            starts = [b[0] for b in blocks]
            long = [b for b in blocks if b[1] - b[0] > _LONG]

            def beaten(first: int, end: int, label: str, held: tuple[float, int]) -> bool:
                near = blocks[bisect_left(starts, first - _LONG) : bisect_left(starts, end)]
                return any(l != label and a < end and first < b and h > held for a, b, l, h in chain(near, long))

            blocks = [b for b in blocks if not beaten(*b)]
        out += [(label, first, end, held) for first, end, label, (held, _) in blocks]
    return sorted(out)


def matches(index: Index, finder: Finder, text: str, words: list[bytes]) -> list[tuple[str, int, int, float]]:
    """(label, first word, end, containment) of each matching block."""
    found_tokens = finder.find(words)
    if not any(token in index.by_token for _, token in found_tokens):
        return []
    places = [p for p, _ in found_tokens]
    line_of = _lines(text)
    blocks: dict[tuple[int, int], set[int]] = {}

    def tokens_in(first: int, end: int) -> set[int]:
        held = blocks.get((first, end))
        if held is None:
            lo, hi = bisect_left(places, first), bisect_left(places, end)
            held = blocks[first, end] = {k for p, k in found_tokens[lo:hi] if p + index.size[k] <= end}
        return held

    asked: dict[tuple[int, int], set[int]] = {}
    for place, token in found_tokens:
        for template, _ in index.by_token.get(token, ()):
            window = index.templates[template][6]
            step = window // 2
            for k in range(max(0, place // step - 1), place // step + 1):
                if k == 0 or k * step + step < len(words):
                    asked.setdefault((k * step, min(k * step + window, len(words))), set()).add(template)
            line = bisect_right(line_of, place) - 1
            asked.setdefault((line_of[line], line_of[line + 1]), set()).add(template)
    found: dict[tuple[str, str, int, int], tuple[float, int]] = {}
    for (first, end), templates in asked.items():
        block = tokens_in(first, end)
        for template in templates.intersection(index.candidates(sorted(block), end - first)):
            held = index.match(template, block)
            if held:
                label, family, own = index.templates[template][:3]
                key = label, family, first, end
                found[key] = max((held, len(own)), found.get(key, (0.0, 0)))
    return _best(found)


def _counts(finder: Finder):
    """The function for ``mapInArrow``: how many documents hold each token, one row per token and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update({token for _, token in finder.find(words_of(text.as_py() or ""))})
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(counts), pa.int64()), "n": pa.array(counts.values(), pa.int64())})

    return run


def _scan(index: Index, phrases: Mapping[str, str]):
    """The function for ``mapInArrow``."""
    finder = Finder(index.number)
    starts: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for phrase, label in phrases.items():
        words = words_of(phrase)
        starts.setdefault(words[0], []).append((words, label))
    begins = frozenset(starts)

    def one(text: str) -> tuple:
        words = words_of(text)
        places, base = [], set()
        for word in begins.intersection(words):
            at = -1
            for _ in range(words.count(word)):
                at = words.index(word, at + 1)
                for phrase, label in starts[word]:
                    if words[at : at + len(phrase)] == phrase:
                        places.append(at)
                        base.add(label)
        found = matches(index, finder, text, words)
        labels = base | {label for label, _, _, _ in found}
        score = max([1.0 if base else 0.0, *(held for _, _, _, held in found)])
        spans = [{"label": a, "first": b, "end": c, "containment": v} for a, b, c, v in found]
        return (len(words), len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), score, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(text.as_py() or "") for text in batch.column(1)]
            columns = list(zip(*rows)) or [()] * len(_FOUND)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, _FOUND)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[batch.schema.names[0], *_FOUND.names])

    return run


_FOUND = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("blocks", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))),
])
_DDL = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "blocks array<struct<label: string, first: bigint, end: bigint, containment: double>>"
)


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES, threshold: float = 0.8,
) -> DataFrame:
    """Per row: words, phrase places, labels and the matching ``blocks`` with their word spans.

    ``score`` is the largest containment found, 1 where a phrase stands, else 0.
    """
    size = sum(len(x.encode()) for x in [*(t.text for t in templates), *phrases])
    if size > MOST_TEMPLATES:
        raise ValueError(f"templates and phrases have {size} bytes; {MOST_TEMPLATES} at most")
    known = sorted({token for t in templates for token in tokens_of(words_of(t.text))})
    finder = Finder({token: i for i, token in enumerate(known)})
    counted = docs.select(text).mapInArrow(_counts(finder), "token long, n long")
    # At most one row per token of the templates.
    counts = {known[r["token"]]: r["n"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}
    found = docs.select(key, text)
    ddl = found.select(key).schema.simpleString()[7:-1] + ", " + _DDL
    return found.mapInArrow(_scan(Index(templates, counts, threshold), phrases), ddl)
