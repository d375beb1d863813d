"""Lexical search, order MinHash and tokenizer alignment against brute force in plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from skillgap.llm import align, lexical, ordermin
from skillgap.llm.queries import BYTES, QUERIES, model_path, table

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = [None, "", " \n\t ", "x" * 70_000, "a b", "a b", "A B c1", "Straße ñandú 日本語 emoji 😀 \x00 \x1c end", "▁ marked", "<|endoftext|> <s></s>",
       " " * 3000 + "wide", "tail" + "\n" * 2000, "é́", "the the the the"]
DOCS = "doc_id long, text string, id long, part int, chunk long, n long, score string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 1, 2, 3, 4, "s") for i, t in enumerate(ODD)] + [(4, "a b", 1, 2, 3, 4, "s"), (None, "a b", 1, 2, 3, 4, "s"), (None, None, *[None] * 5), (None, "a b", *[None] * 5)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_search(docs, items, top=10):
    """docs: (doc_id, text); items: (item_id, text). Rows of (item_id, rank, doc_id, score)."""
    held = [(k, Counter(w), len(w)) for k, t in docs if (w := TERM.findall(lowered(t)))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked = TERM.findall(lowered(text))
        scored = []
        for k, c, size in held:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if c[t]
            )
            if s > 0:
                scored.append((-s, k is None, k or 0))
        for rank, (s, is_none, k) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, None if is_none else k, -s))
    return out


def packed(rows):
    return sorted(map(repr, rows))


def test_op11_by_scoring_all(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    found = QUERIES["op11_lexical"](spark, SF).collect()
    assert packed(tuple(r) for r in found) == packed(brute_search(docs, items))


def test_search_over_odd_rows_and_small_trees(spark, odd, none):
    items = [(1, "a b c1"), (1, "a b c1"), (2, None), (3, "!!!"), (None, "the X end"), (5, "nowhere"), (6, "b b B a")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute_search([(r["doc_id"], r["text"]) for r in odd.collect()], items)
    for more in ({}, {"tree": 4, "leaf": 1}, {"query_bytes": 90}, {"tree": 8, "leaf": 2, "top": 3}):
        found = lexical.search(odd, asked, **more).collect()
        assert packed(tuple(r) for r in found) == packed([w for w in want if w[1] <= more.get("top", 10)])
    assert lexical.search(none, asked).collect() == [] and lexical.search(odd, asked.limit(0)).collect() == []


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(5)
    centres = [np.sort(rnd.choice(400, 12, replace=False)) for _ in range(30)]
    profiles = [rnd.integers(10**5, 10**6, 12) for _ in centres]
    first, term, value = [0], [], []
    for i in range(1500):
        # Documents of thirty kinds, and some of none.
        kind = i % 31
        own = centres[kind] if kind < 30 else np.sort(rnd.choice(400, 12, replace=False))
        term.append(own)
        value.append((profiles[kind % 30] * rnd.uniform(0.9, 1.1, 12)).astype(np.int64))
        first.append(first[-1] + len(own))
    first, term, value = np.array(first), np.concatenate(term), np.concatenate(value).astype(np.int64)
    ball = lexical.BallTree(first, term, value, leaf=16)
    space, share = np.zeros(len(ball.terms), np.int64), []
    for centre in centres:
        weight = rnd.integers(1, 20_000, len(centre))
        query = np.zeros(400, np.int64)
        query[centre] = weight
        scores = np.add.reduceat(query[term] * value, first[:-1])
        at = np.searchsorted(ball.terms, centre)
        bound = ball.bounds(at, weight)
        below = lambda n: ball.leaves[n][0].tolist() if n in ball.leaves else below(ball.children[n][0]) + below(ball.children[n][1])
        for node in range(len(ball.radii)):
            assert scores[below(node)].max() <= bound[node]
        best: list[int] = []

        def take(rows, own):
            assert (own == scores[rows]).all()
            best.extend(own.tolist())
            best.sort(reverse=True)
            del best[10:]

        share.append(ball.search(centre, weight, space, lambda: best[9] if len(best) == 10 else 1, take) / len(ball.leaves))
        assert best == sorted(scores.tolist(), reverse=True)[:10] and not space.any()
    assert np.mean(share) < 0.6


MASK64 = 2**64 - 1


def mixed(x):
    x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & MASK64
    x = (x ^ (x >> 29)) * 0x9E3779B97F4A7C15 & MASK64
    return x ^ (x >> 32)


def brute_fingerprint(text):
    """Straight from the definition: every slot selects over all numbered k-mers."""
    if not text:
        return "0" * 8 * ordermin.SLOTS
    size = min(ordermin.K, len(text))
    runs = [text[i : i + size] for i in range(len(text) - size + 1)]
    codes = [int(h) >> 24 for h in ordermin.kmers(np.array([ord(c) for c in text], np.uint64))]
    assert len(set(codes)) == len(set(runs))
    met, marks = Counter(), []
    for run, code in zip(runs, codes):
        marks.append(mixed((code + met[run] * 0xD6E8FEB86659FD93) & MASK64) >> 32)
        met[run] += 1
    out = ""
    for mask in ordermin._MASKS[:, 0].tolist():
        picked = sorted(range(len(runs)), key=lambda i: (marks[i] ^ mask, codes[i], i))[: ordermin.PICKED]
        slot = len(picked)
        for i in sorted(picked):
            slot = mixed((slot * 0x9E3779B97F4A7C15 + codes[i]) & MASK64)
        out += f"{slot >> 32:08x}"
    return out


def check_edited(rows, found):
    """rows: (doc_id, text) in reading order."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in order]
    print_of = {}

    def prints(t):
        if t not in print_of:
            print_of[t] = brute_fingerprint(t)
        return print_of[t]

    def like(a, b):
        return sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) * 8 / len(a)

    want = []
    for i, (k, _) in enumerate(order):
        own, after = texts[i], texts[(i + 1) % len(order)]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        a, b, c = prints(own), prints(edited), prints(after)
        want.append((k, len(own), hashlib.sha256(edited.encode()).hexdigest(), a, b, like(a, b), like(a, c)))
    assert packed(want) == packed(tuple(r) for r in found)


def test_op12_by_definition(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    found = QUERIES["op12_order_minhash"](spark, SF).collect()
    short = [(k, t if len(t or "") < 30_000 else None) for k, t in rows]
    if short == rows:
        check_edited(rows, found)
    else:  # a brute-force pass over the longest texts takes minutes; the digests of all are checked
        order = sorted(rows, key=lambda r: -r[0])
        by = {r["doc_id"]: r for r in found}
        assert by.keys() == dict(rows).keys()
        for (k, t), (_, after) in zip(order, order[1:] + order[:1]):
            t, after = t or "", after or ""
            half = len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            assert by[k]["n_chars"] == len(t) and by[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            if len(t) + len(after) < 10_000:
                assert by[k]["fingerprint"] == brute_fingerprint(t) and by[k]["edited_fingerprint"] == brute_fingerprint(edited)
    assert np.mean([r["near_edited"] for r in found]) > np.mean([r["near_next"] for r in found])


@pytest.mark.parametrize("parts", [1, 2, 5, 40])
def test_next_documents_over_odd_rows(spark, none, parts, tmp_path):
    texts = [t if len(t or "") < 10_000 else t[:900] for t in ODD]
    rows = [(i * 3, t, 1, 2, 3, 4, "s") for i, t in enumerate(texts)] + [(3, "b a", 1, 2, 3, 4, "s"), (None, "a b", 1, 2, 3, 4, "s"), (None, None, *[None] * 5), (-7, "minus", 1, 2, 3, 4, "s")]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(str(tmp_path / "t"))
    found = ordermin.edited_report(spark.read.parquet(str(tmp_path / "t")), parts=parts).collect()
    check_edited([(r[0], r[1]) for r in rows], found)
    assert ordermin.edited_report(none, parts=parts).collect() == []
    one = spark.createDataFrame([(1, "only", 1, 2, 3, 4, "s")], DOCS)
    (r,) = ordermin.edited_report(one, parts=parts).collect()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"onon").hexdigest()


def test_prints_follow_edit_distance(spark):
    rnd = random.Random(9)
    text = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(500))
    own = ordermin.fingerprint(text)

    def edited(n):
        t = list(text)
        for i in rnd.sample(range(len(t)), n):
            t[i] = "z"
        return ordermin.likeness(own, ordermin.fingerprint("".join(t)))

    few, more, many = edited(3), edited(60), edited(600)
    assert few > more > many and few > 0.8
    half = len(text) // 2
    # The same words in another order: set-based fingerprints would not tell.
    assert ordermin.likeness(own, ordermin.fingerprint(text[half:] + " " + text[:half])) < 0.75
    long = "lorem ipsum " * 120_000
    assert (ordermin.fingerprint(long) == ordermin.fingerprint(long + "")).all()
    assert ordermin.likeness(ordermin.fingerprint(long), ordermin.fingerprint(long + "x")) > 0.9


@pytest.fixture(scope="module")
def libraries():
    byte = Tokenizer.from_file(model_path(BYTES))
    byte.encode_special_tokens = True
    piece = sentencepiece.SentencePieceProcessor(model_file=model_path())
    letters = align._byte_letters()
    return byte, piece, letters


def brute_alignment(rows, libraries):
    """rows: (doc_id, text). The report's rows, from overlaps of byte ranges."""
    byte, piece, letters = libraries
    vocabulary = {i: w for w, i in byte.get_vocab().items()}
    told, counts = [], Counter()

    def ranges(parts):
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    for k, text in rows:
        a = byte.encode(" " + text, add_special_tokens=False).ids if text else []
        b = piece.encode(text) if text else []
        parts_a = [bytes(letters[c] for c in vocabulary[i]) for i in a]
        parts_b = [bytes([int(p[3:5], 16)]) if piece.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [piece.id_to_piece(i)]]
        if not text or not b"".join(parts_a) == b"".join(parts_b) == b" " + text.encode():
            a, b, parts_a, parts_b = [], [], [], []
        ra, rb = ranges(parts_a), ranges(parts_b)
        links, j = [], 0
        for i, (lo, hi) in enumerate(ra):
            while j and rb[j - 1][1] > lo:
                j -= 1
            while j < len(rb) and rb[j][0] < hi:
                if rb[j][1] > lo:
                    links.append((a[i], b[j]))
                j += 1
        counts.update(links)
        cuts = sorted({hi for _, hi in ra} & {hi for _, hi in rb})
        groups, lo = [], 0
        for hi in cuts:
            inside = [[str(x) for x, (s, e) in zip(ids, rs) if lo <= s and e <= hi] for ids, rs in ((a, ra), (b, rb))] if len(ra) < 500 else None
            groups.append(inside)
            lo = hi
        told.append((k, len(a), len(b), groups, links))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for k, n_a, n_b, groups, links in told:
        sha = None
        if not groups:
            sha = ""
        elif groups[0] is not None:
            sha = hashlib.sha256(";".join(",".join(a) + "|" + ",".join(b) for a, b in groups).encode()).hexdigest()
        out.append((k, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out


def same_alignment(found, want):
    cut = lambda rows, known: packed((*r[:7], r[7] if known[i] else None) for i, r in enumerate(rows))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:7])
    found, want = sorted((tuple(r) for r in found), key=key), sorted(want, key=key)
    known = [w[7] is not None for w in want]
    assert cut(found, known) == cut(want, known)
    assert any(known)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_op13_by_byte_ranges(spark, libraries):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    same_alignment(QUERIES["op13_alignment"](spark, SF).select(*COLUMNS).collect(), brute_alignment(rows, libraries))


def test_alignment_of_odd_rows(spark, odd, none, libraries):
    rnd = random.Random(2)
    alphabet = " a  bth▁\n\x00\x01éeé日本語<0x41>😀́\t.,'s 're<|endoftext|>"
    more = [(100 + i, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80)))) for i in range(300)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).cache()
    want = brute_alignment([(r["doc_id"], r["text"]) for r in docs.collect()], libraries)
    for chunk in (4_000_000, 300):
        found = align.alignment_report(docs, model_path(BYTES), model_path(), chunk=chunk).select(*COLUMNS).collect()
        same_alignment(found, want)
    assert align.alignment_report(none, model_path(BYTES), model_path()).collect() == []
    for r in align.align_tokens(odd.filter("doc_id = 7"), model_path(BYTES), model_path()).collect():
        assert len(r["a_ids"]) == len(r["a_group"]) and r["a_group"][0] == 0 and r["a_group"][-1] == r["b_group"][-1]
    assert align.align_tokens(odd, model_path(BYTES), model_path()).count() == odd.count()


def test_alignment_chunks_are_many_short_rows():
    """Documents of one chunk leave a worker a block at a time, however many they are; the blocks share the chunk's pairs."""
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdehilnorst", k=rnd.randint(1, 9))) for _ in range(400)]
    texts = [" ".join(rnd.choices(words, k=2500)) for _ in range(60)] + [None, ""]
    files = align.read_file(model_path(BYTES)), align.read_file(model_path())
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    assert 3 * align.SLICE < sum(len(t or "") for t in texts) < align.CHUNK
    found = [r for out in align._chunks(*files, align.CHUNK)(iter([batch])) for r in out.to_pylist()]
    blocks, (last,) = [r for r in found if r["doc_id"] is not None], [r for r in found if r["pairs"] is not None]
    assert {r["chunk"] for r in found} == {0} and found[-1] is last and last["doc_id"] is None
    assert [k for r in blocks for k in r["doc_id"]] == list(range(len(texts)))
    assert all(r["pairs"] is None and sum(len(texts[k] or "") for k in r["doc_id"]) <= align.SLICE for r in blocks)
    aligner, links, told = align._aligner(*files), Counter(), Counter()
    for r in blocks:
        for d, k in enumerate(r["doc_id"]):
            x = aligner.align([texts[k]])
            want = Counter((x.a_ids[x.link_a] << 32 | x.b_ids[x.link_b]).tolist())
            own = slice(r["first"][d], r["first"][d + 1])
            assert dict(zip([last["pairs"][p] for p in r["at"][own]], r["times"][own])) == want
            links += want
            told[k] = r["n_links"][d]
    assert dict(zip(last["pairs"], last["n"])) == links and sum(told.values()) == sum(links.values())


def test_alignment_of_chunks_of_many_blocks(spark, libraries):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdehilnorst", k=rnd.randint(1, 9))) for _ in range(300)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.choice([3, 9000])))) for i in range(24)] + [(None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    found = align.alignment_report(docs, model_path(BYTES), model_path()).select(*COLUMNS).collect()
    same_alignment(found, brute_alignment(rows, libraries))


def test_pointers_reach_the_end_of_long_chains():
    """Tokens of two bytes, set off by one: one component of any length."""
    n = 50_000
    a, b = np.arange(2, 2 * n + 1, 2), np.append(np.arange(1, 2 * n, 2), 2 * n)
    ga, gb = align.components(a, b)
    assert not ga.any() and not gb.any()
    ga, gb = align.components(np.array([3, 5, 9]), np.array([1, 3, 6, 9]))
    assert ga.tolist() == [0, 1, 1] and gb.tolist() == [0, 0, 1, 1]


def test_public_tokenizer_pattern_is_the_fixed_one():
    assert align.PATTERN == public_tokenizers.PATTERN
