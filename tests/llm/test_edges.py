"""Empty tables, nulls, very long and empty texts, ties, repeated rows and clashing names, for every operator."""

from __future__ import annotations

import hashlib
import random
import re
import resource
import time
import tracemalloc

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from skillgap.llm import chat, components, langid, license_texts, licenses, mixing, pieces, quality_net, rules, simhash, vectors, warc
from skillgap.llm.queries import model_path, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, root string, component_id int"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
TEXTS = [None, "", " \n\t ", "x" * 70_000, LONG, "All rights reserved.", "the the the the the the the the the the",
         "Straße ñandú 日本語   emoji 😀 \x00 \x1c end", "a b", "a b"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ["en", None, "fr"][i % 3], ["s", None][i % 2], 1, 2, "r", 3) for i, t in enumerate(TEXTS)]
    rows += [(9, "a b", "en", "s", 1, 2, "r", 3), (None, "a b", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def report(name, df, spark):
    labels = spark.createDataFrame([(0, 0, 1), (4, 1, 0), (5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return {
        "pieces": lambda: pieces.encode_pieces(df, model_path()),
        "mixing": lambda: mixing.mix_report(df),
        "licenses": lambda: licenses.scan_licenses(df),
        "simhash": lambda: simhash.near_report(df),
        "langid": lambda: langid.language_report(df),
        "quality": lambda: quality_net.quality_report(df, labels),
        "rules": lambda: rules.apply_rules(df),
    }[name]()


@pytest.mark.parametrize("name", ["pieces", "mixing", "licenses", "simhash", "langid", "quality", "rules"])
def test_a_row_for_every_row(spark, odd, none, name):
    found = report(name, odd, spark).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in found), key=key) == sorted((r["doc_id"] for r in odd.collect()), key=key)
    assert report(name, none, spark).collect() == []


def test_pieces_on_any_text(spark):
    rnd = random.Random(3)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = " a  bth▁\n\x00\x01éeé日本語<0x41>😀́\t.,<s></s>�"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(400)] + [t for t in TEXTS if t]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pieces.encode_pieces(df, model_path(), whole=True).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)
    codec = pieces.Codec(pieces.read_model(model_path()), remembered=5000)  # forgets all the time
    assert [codec.encode(t) for t in texts] == [library.encode(t) for t in texts]
    assert codec.decode([300, 5, 3, 200, 0, 1]) == library.decode([300, 5, 3, 200, 0, 1])


def test_texts_of_one_word_are_not_remembered():
    """Texts that are one word of 100 KB each, and words without end: no worker holds on to them."""
    codec = pieces._codec(pieces.read_model(model_path()))
    rnd = random.Random(1)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for _ in range(4):
        texts = ["".join(rnd.choices("abcdefghij", k=1000)) * 100 for _ in range(5)]
        assert len(codec.encode_all(texts)) == 5 and not codec.wrong
        assert max(map(len, codec._ids), default=0) <= pieces.REMEMBERED_CHARS
    words = [[f"{i}w{j}" for j in range(2000)] for i in range(30)]
    for some in words:
        codec.encode_all([" ".join(some)])
    held = sum(len(k) + len(v) for k, v in codec._ids.items())
    assert held < codec._held <= pieces.REMEMBERED_BYTES
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 500


def test_plain_words_are_learned_together():
    """Ids, decoded forms and the library's answers of plain words are handled for all at once; others one by one."""
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    codec, single = pieces.Codec(pieces.read_model(model_path()), library=library), []
    entry = codec._entry
    codec._entry = lambda *args: single.append(args) or entry(*args)
    text = " ".join(f"word{i}s" for i in range(500)) + "\nlines begin\n\nhere \x00 and \x01"[:-2] + " 😀\u0378 ends "
    assert codec.encode_all([text]) == [(",".join(map(str, library.encode(text))), library.decode(library.encode(text)))]
    assert not codec.wrong and 0 < len(single) < 10
    class Other:
        def encode(self, texts, num_threads=1):
            return [[i + (t == "word7s") for i in ids] for t, ids in zip(texts, library.encode(texts))]
    other = pieces.Codec(pieces.read_model(model_path()), library=Other())
    other.encode_all([text])
    assert other.wrong == ["word7s"]


PAGES = [
    (1, "http://a.example/x?q=1#f", "<p>one</p>"), (2, "http://a.example/y", "<p>one</p>"), (3, None, None), (4, "u\r\nX: y", ""),
    (5, "http://b.example", "WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"), (6, "", "\r\n\r\n"), (7, "", "ends\r\n"), (8, "", "ends\r"),
    (9, "", "é😀\x00"), (10, "", "<p>one</p>"), (11, "", "z" * 3_000_000), (12, "", "\r\n"), (12, "", "\r\n"), (None, "", "nul"), (None, "", "nul"),
]


def test_archives_keep_every_page(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, digest string, id int").repartition(3).cache()
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path)
    assert {r["type"]: r["count"] for r in records.groupBy("type").count().collect()} == {"request": 15, "metadata": 15, "response": 10, "revisit": 5}
    captures = warc.assemble(records)
    for r in captures.collect():
        assert len(r["requests"]) == len(r["metadata"]) == 1 and r["response"]["type"] in ("response", "revisit")
    found = warc.page_report(warc.assemble(warc.read_archives(spark, path, blocks=False))).collect()
    assert len(found) == len(PAGES)
    html = {i: h or "" for i, _, h in PAGES}
    for r in found:
        body = html[r["page_id"]].encode()
        same = [i for i, h in html.items() if h.encode() == body]
        top = max((i for i in same if i is not None), default=None)
        assert r["payload_bytes"] == len(body)
        import base64

        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        if r["record_type"] == "revisit":
            assert r["refers_to"] == top
        else:
            assert r["page_id"] == top and r["refers_to"] is None
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.page_report(warc.assemble(warc.read_archives(spark, str(tmp_path / "none")))).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "", "ab"), (2, "", "ab"), (3, "", "abc"), (4, "", "abc")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), least_bytes=3)
    found = {r["page_id"]: r["record_type"] for r in warc.page_report(warc.assemble(warc.read_archives(spark, str(tmp_path / "w")))).collect()}
    assert found == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_records_of_others(spark, tmp_path):
    """Concatenated gzip members, a pointer by way of another record, an orphan and broken records."""
    import gzip

    def record(kind, id_, body, *more, length=None):
        head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + id_ + b">", *more]
        head.append(b"Content-Length: %d" % (len(body) if length is None else length))
        return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"

    to = lambda x: b"WARC-Concurrent-To: <" + x + b">"
    members = [
        record(b"warcinfo", b"i", b"software: x\r\n"), record(b"request", b"q", b"GET / HTTP/1.1\r\n\r\n", to(b"r")),
        record(b"response", b"r", b"HTTP/1.1 200 OK\r\n\r\nhi", b"Content-Type: application/http;\r\n msgtype=response"),
        record(b"metadata", b"m", b"a: 1\r\n", to(b"q"), b"Content-Type: application/warc-fields"), record(b"metadata", b"lost", b"", to(b"nowhere")),
        b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", record(b"request", b"cut", b"GET", length=900),
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in members))
    records = warc.read_archives(spark, str(tmp_path / "in"))
    assert sorted(r["type"] for r in records.collect()) == sorted(["warcinfo", "request", "response", "metadata", "metadata", "damaged", "damaged"])
    found = {r["capture_id"]: r for r in warc.assemble(records).collect()}
    assert found.keys() == {"<r>", "<lost>"} and found["<lost>"]["response"] is None
    assert [x["record_id"] for x in found["<r>"]["requests"]] == ["<q>"] and found["<r>"]["metadata"][0]["fields"] == {"a": "1"}
    assert found["<r>"]["response"]["payload_bytes"] == 2


def test_captures_by_any_way_without_ids_and_twice(spark, tmp_path):
    """Records that meet in a third, records without an identifier, and an archive that lies in two folders."""
    import gzip

    def record(kind, id_, body, *to):
        head = ["WARC/1.1", f"WARC-Type: {kind}", *([f"WARC-Record-ID: <{id_}>"] if id_ else []), *[f"WARC-Concurrent-To: <{x}>" for x in to]]
        head += ["Content-Type: " + ("application/warc-fields" if kind == "metadata" else "application/http"), f"Content-Length: {len(body)}"]
        return gzip.compress(("\r\n".join(head) + "\r\n\r\n" + body + "\r\n\r\n").encode())

    http = "HTTP/1.1 200 OK\r\n\r\n"
    members = [
        record("response", "r1", http + "1", "q1"), record("request", "q1", "GET"), record("metadata", "m1", "page-id: 1\r\n", "q1"),
        record("response", "r2", http + "22"), record("request", "q2", "GET", "r2", "m2"), record("metadata", "m2", "page-id: 2\r\n"),
        record("response", "r3", http + "333", "r2"), record("metadata", None, "page-id: 3\r\n", "r3"),
        record("response", None, http + "4444"), record("response", None, http + "55555", "q5"), record("request", "q5", "GET"),
        record("metadata", None, "page-id: 6\r\n"), record("metadata", None, "page-id: 7\r\n"),
    ]
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.warc.gz").write_bytes(b"".join(members))
    told = lambda r: (
        r["capture_id"], r["response"] and r["response"]["payload_bytes"], [x["record_id"] for x in r["requests"]], [x["fields"]["page-id"] for x in r["metadata"]])
    want = [
        ("<r1>", 1, ["<q1>"], ["1"]), ("<r2>", 2, ["<q2>"], ["2"]), ("<r3>", 3, [], ["3"]), (None, 4, [], []), (None, 5, ["<q5>"], []),
        (None, None, [], ["6"]), (None, None, [], ["7"]),
    ]
    once = warc.assemble(warc.read_archives(spark, str(tmp_path / "a")))
    assert sorted(map(told, once.collect()), key=str) == sorted(want, key=str)
    twice = warc.assemble(warc.read_archives(spark, str(tmp_path / "*")))
    assert sorted(map(told, twice.collect()), key=str) == sorted([x for x in want for _ in range(2 if x[1] else 1)], key=str)
    pages = lambda c: sorted((r["page_id"] or 0, r["payload_bytes"]) for r in warc.page_report(c).collect())
    assert pages(once) == [(0, 4), (0, 5), (1, 1), (2, 2), (3, 3)] and pages(twice) == sorted(pages(once) * 2)


def test_mix_emits_whole_rows(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", f"s{i % 4}" if i % 4 else None, i) for i in range(400)] + [(7, "w", "en", "tiny", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __row_ long").repartition(4).cache()
    taken = {r["doc_id"]: r for r in mixing.mix_report(docs).where("source_size > 1").collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.where("source <> 'tiny' OR source IS NULL").groupBy("doc_id").count().collect()}
    assert {k: r["taken"] // r["size"] for k, r in taken.items() if r["taken"]} == counts
    targets = {r["source"]: (r["source_size"], r["target"]) for r in mixing.targets(mixing.sizes(docs).select("source", "size")).collect()}
    total = sum(s for s, _ in targets.values())
    assert sum(t for _, t in targets.values()) == pytest.approx(total) and targets["tiny"] == (1, 3.0)


def test_sums_of_one_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * 7 % 5000).alias("v"))
    got = mixing.summed(df, ["k"], ["v"], "v").collect()
    hot = sorted((r["v"], r["upto"]) for r in got if r["k"] == "hot")
    assert [u for _, u in hot] == np.cumsum([v for v, _ in hot]).tolist() and all(r["upto"] == r["v"] for r in got if r["k"] != "hot")
    cut = mixing.summed(df, ["k"], ["v"], "v", 1000).collect()
    assert {(r["v"], r["upto"] % 1000) for r in cut} == {(r["v"], r["upto"] % 1000) for r in got}


def test_copies_where_shares_differ(spark):
    """Expected copies of each row's own, with a group that holds most rows, against plain sums."""
    rnd = random.Random(6)
    rows = [(i, "hot" if i % 5 else f"g{i % 35}" if i % 2 else None, rnd.choice([0.0, 0.25, 1 / 3, 1.0, 1.7, 2.999, 3.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "row long, kind string, expected double").repartition(7)
    got = {r["row"]: r["copies"] for r in mixing.emitted(df, "kind", ["row"], "expected", "s").collect()}
    for kind in {k for _, k, _ in rows}:
        code = hashlib.md5(("s|" + ("null" if kind is None else "s" + kind)).encode()).hexdigest()
        at = int(code[:8], 16)
        own = [(i, e) for i, k, e in rows if k == kind]
        for i, e in own:
            before, at = at, at + int(np.floor(e * mixing.UNIT + 0.5))
            assert got[i] == at // mixing.UNIT - before // mixing.UNIT
            assert e - 1 < got[i] < e + 1
        assert abs(sum(got[i] for i, _ in own) - sum(e for _, e in own)) < 1.001


def license_words(text):
    return [w.encode() for w in re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]


def grams(words):
    n = min(3, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute_license(text, templates, threshold):
    """Every line and every window against every template, by plain sets; then rivals by hand."""
    words = license_words(text)
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(license_words(line))))
        at = lines[-1][1]
    found = {}
    for t in templates:
        own = license_words(t.text)
        size = 16
        while size < 2 * len(own):
            size *= 2
        blocks = set(lines) | {(s, min(s + size, len(words))) for s in range(0, len(words), size // 2) if s == 0 or s + size // 2 < len(words)}
        wanted = grams(own)
        others = set().union(*(grams(license_words(o.text)) for o in templates if t.family and o.family == t.family and o.label != t.label), set())
        telling = wanted - others
        for first, end in blocks:
            here = grams(words[first:end]) if end - first >= 3 else set()
            if len(own) < 3:
                here = {tuple(words[i : i + len(own)]) for i in range(first, end - len(own) + 1)}
            held = len(wanted & here)
            if held and held >= threshold * len(wanted) - 1e-9 and len(telling & here) >= threshold * len(telling) - 1e-9:
                key = (t.label, t.family or t.label, first, end)
                found[key] = max(found.get(key, (0, 0)), (held / len(wanted), len(wanted)))
    keep = set()
    for (label, family, a, b), held in found.items():
        if not any(f == family and l != label and c < b and a < d and h > held for (l, f, c, d), h in found.items()):
            keep.add((label, a, b, round(held[0], 9)))
    return keep


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_every_block_is_found(spark, threshold):
    rnd = random.Random(8)
    pool = [t.text for t in licenses.TEMPLATES]
    texts = []
    for _ in range(120):
        words = []
        for _ in range(rnd.randint(1, 4)):
            part = rnd.choice(pool).split()
            lo = rnd.randint(0, len(part) // 3)
            part = part[lo : lo + rnd.choice([3, 8, 40, 500])]
            for _ in range(rnd.choice([0, 0, 1, 4])):
                part[rnd.randrange(len(part))] = "other"
            words += part + ["filler"] * rnd.choice([0, 1, 9, 30])
        texts.append("".join(w + rnd.choice(["\n", " ", " ", " ", ", "]) for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan_licenses(df, threshold=threshold).collect():
        got = {(b["label"], b["first"], b["end"], round(b["containment"], 9)) for b in r["blocks"]}
        assert got == brute_license(texts[r["doc_id"]], licenses.TEMPLATES, threshold)


def test_positional_filter_rejects():
    t = license_texts.Template("x", "a b c d e f g h i j")
    index = licenses.Index([t], {}, 0.5)
    own = index.templates[0][2]
    assert own == list(range(8)) and index.templates[0][3] == 4
    # Enough tokens and a prefix token; of those that follow it in corpus order there are too few.
    assert list(index.candidates(own[4:6] + [100], 50)) == []
    assert list(index.candidates(own[4:8], 50)) == [0] and list(index.candidates(own[:4], 3)) == []


#: Texts and the labels that are right for them.
PROBES = {
    "Released under the BSD License.": "bsd",
    "licensed under CC BY 4.0": "cc-by,cc-by-4.0",
    "Licensed under the license, version 2.0 of something": "",
    "This work is licensed under the GNU General Public License version 2": "gpl,gpl-2.0",
    "No rights were reserved; all is free": "",
    "the license under released mit": "",
    "This work is licensed under the GNU General Public License, version 4": "gpl",
    "licensed under CC BY-NC-ND 4.0": "cc-by,cc-by-nc-nd-4.0",
    "Released under the\nMIT License.": "mit",
    "This work is licensed under the GNU General\nPublic License, version 3": "gpl,gpl-3.0",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "All rights reserved.": "all-rights-reserved,reserved",
}


def test_labels_are_the_right_ones(spark):
    base = {"gnu": "gpl", "cc": "cc-by"}
    cases = list(PROBES.items())
    rnd = random.Random(4)
    for t in licenses.NOTICES:
        words = t.text.split()
        cases.append((t.text, t.label))
        # Wrapped otherwise, inside other text, and with a word in twenty changed.
        wrapped = "\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7))
        cases.append((LONG[:5000] + "\n# " + wrapped + "\n" + LONG[:777], t.label))
        if len(words) > 60:
            changed = [w if rnd.random() > 0.02 else "xx" for w in words]
            cases.append((" ".join(changed), t.label))
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string")
    assert len({t.label for t in licenses.NOTICES}) >= 20
    for r in licenses.scan_licenses(df).collect():
        text, want = cases[r["doc_id"]]
        named = set(filter(None, want.split(",")))
        got = set(filter(None, r["labels"].split(",")))
        if text in PROBES:
            assert got == named, (text, r["labels"])
        else:
            # The base finds its phrases in some notices; no other license may be named.
            assert got - set(r["base_labels"].split(",")) - {"all-rights-reserved"} == named - set(r["base_labels"].split(",")), (text[:80], r["labels"])


def test_wrapped_statements_are_found(spark):
    """Each statement wrapped at every word, and at all of them, behind texts that move it over the windows' ends."""
    cases = []
    for t in licenses.STATEMENTS:
        words = t.text.split()
        wraps = [" ".join(words[:i]) + "\n" + " ".join(words[i:]) for i in range(1, len(words))] + ["\n".join(words), "\r\n\n".join(words)]
        for before in (0, 1, 7, 8, 9, 14, 15, 16, 31):
            cases += [(t.label, len(license_words(t.text)), before, "f " * before + "\n" * (before % 2) + wrap + " and\nmore " + "g " * 40) for wrap in wraps]
    df = spark.createDataFrame([(i, c[3]) for i, c in enumerate(cases)], "doc_id long, text string")
    found = licenses.scan_licenses(df, threshold=1.0).collect()
    assert len(found) == len(cases)
    for r in found:
        label, size, before, _ = cases[r["doc_id"]]
        assert label in r["labels"].split(",") and r["score"] == 1
        assert any(b["label"] == label and b["first"] <= before and before + size <= b["end"] for b in r["blocks"])


def test_many_statements_in_one_text():
    """A text of tens of thousands of license lines, rivals among them, takes no time that grows with their square."""
    index = licenses.Index(licenses.TEMPLATES, {}, 0.8)
    text = "\n".join(["All rights reserved.", "Licensed under CC BY 4.0", "GNU General Public License, version 3", "x y z"] * 10_000)
    start = time.time()
    found = licenses.matches(index, licenses.Finder(index.number), text, licenses.words_of(text))
    assert time.time() - start < 60 and {x[0] for x in found} == {"all-rights-reserved", "cc-by-4.0", "gpl-3.0"}


@pytest.mark.parametrize("distance,block", [(4, 8192), (4, 3), (3, 5), (7, 50)])
def test_links_of_fingerprints(spark, distance, block):
    """Clusters of fingerprints, dealt out in small blocks too, against all pairs."""
    r = np.random.default_rng(distance * 100 + block)
    prints = []
    for _ in range(40):
        centre = int(r.integers(0, 2**63)) * 2 + int(r.integers(0, 2))
        for _ in range(int(r.integers(1, 12))):
            flipped = centre
            for bit in r.choice(64, int(r.integers(0, 6)), replace=False):
                flipped ^= 1 << int(bit)
            prints.append(flipped)
    prints = np.unique(np.array(prints, np.uint64))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    roots = {x["node"]: x["root"] for x in components.components(simhash.links(df, distance, block)).collect()}
    nodes = components.scatter(prints).tolist()
    got = [roots.get(n, n) for n in nodes]
    root = list(range(len(prints)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if int(prints[i] ^ prints[j]).bit_count() <= distance:
                root[top(i)] = top(j)
    want = [top(i) for i in range(len(prints))]
    pairs = set(zip(got, want))
    assert len(pairs) == len(set(got)) == len(set(want))


def busy_prints(n):
    """``n`` fingerprints under one key, and some under a neighbour that is looked up by all of them."""
    r = np.random.default_rng(3)
    ring = simhash.segments(4)
    low_bits = sum(bits for _, bits in ring[:2])
    fixed = (1 << ring[0][1]) - 1 | 0b10110 << ring[1][0]
    high = np.unique(r.integers(0, 2 ** (64 - low_bits - 1), n, dtype=np.uint64))
    prints = (high << np.uint64(low_bits)) | np.uint64(fixed)
    neighbours = np.array([(int(h) << low_bits) | (fixed ^ 0b10 << ring[1][0]) for h in high[:300].tolist()], np.uint64)
    return np.unique(np.concatenate([prints, neighbours]))


def test_look_ups_of_a_busy_key_are_dealt_out(spark):
    """One key of 50,000 fingerprints: its listings, and the look-ups its neighbours get from it, are cut into blocks."""
    df = spark.createDataFrame(pd.DataFrame({"print": busy_prints(50_000).view(np.int64)}))
    placed = df.mapInArrow(simhash._placed(4), "key long, print long, kind byte")
    block = 2000
    rows = simhash.dealt(placed, simhash.busy_keys(placed, block))
    assert rows.groupBy("key", "part").count().agg(F.max("count")).first()[0] <= 2.3 * block
    assert placed.groupBy("key").count().agg(F.max("count")).first()[0] > 40_000


def test_links_of_a_busy_key(spark):
    every = busy_prints(3000)
    df = spark.createDataFrame(pd.DataFrame({"print": every.view(np.int64)}))
    roots = {x["node"]: x["root"] for x in components.components(simhash.links(df, 4, 200)).collect()}
    plain = {x["node"]: x["root"] for x in components.components(simhash.links(df, 4, 10**9)).collect()}
    assert len(plain) >= 600 and roots.keys() == plain.keys()
    assert len({(roots[n], plain[n]) for n in roots}) == len(set(roots.values())) == len(set(plain.values()))


def test_a_large_star_without_broadcasts(spark):
    """200,000 nodes around one, all joins by shuffle."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        nodes = components.scatter(np.arange(200_001))
        edges = spark.createDataFrame(pd.DataFrame({"a": np.full(200_000, nodes[0]), "b": nodes[1:]})).repartition(8)
        found = components.components(edges)
        assert found.select("root").distinct().count() == 1 and found.count() == 200_001
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_components_of_paths_and_stars(spark):
    path = components.scatter(np.arange(300)).tolist()
    star = components.scatter(np.arange(1000, 1400)).tolist()
    edges = list(zip(path, path[1:])) + [(star[0], s) for s in star[1:]] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[p] for p in path}) == 1 and len({got[s] for s in star}) == 1 and len(set(got.values())) == 2
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_whole_row_stays(spark):
    docs = spark.createDataFrame([(3, LONG, "x"), (1, LONG + " tail", "y"), (1, LONG, "z"), (None, "other text here now", "n"), (5, "other text here now", "m")],
                                 "doc_id long, text string, row string").repartition(2).cache()
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 5]


def test_mixture_finds_both_languages(spark):
    en, fr = "the quick brown fox jumps over the lazy dog and runs away " * 30, "le renard brun saute par dessus le chien paresseux et puis " * 30
    model = langid.learn(spark.createDataFrame([(en, "en"), (fr, "fr"), (None, "de"), ("x", None)], "text string, lang string"))
    assert model.names == ["en", "fr"]
    share, _ = model.proportions(en + fr + fr)
    assert 0.2 < share[0] < 0.45 and share.sum() == pytest.approx(1)
    assert model.proportions(en)[0].tolist() == [1.0, 0.0]


def test_network_scores_any_length():
    r = np.random.default_rng(1)
    good = [bytes(r.integers(97, 123, 400, dtype=np.uint8)) for _ in range(60)]
    bad = [bytes(r.choice(np.frombuffer(b"#$%& ", np.uint8), 400)) for _ in range(60)]
    net = quality_net.fit([quality_net.spread_chunks(t) for t in good + bad], [1] * 60 + [0] * 60)
    scores = net.score(good + bad)
    assert (scores[:60] > 0.5).all() and (scores[60:] < 0.5).all()
    long = good[0] * 4000  # scored in pieces
    maxima = net.chunk_maxima(np.frombuffer(long, np.uint8))
    whole = net.answers(quality_net._padded(np.frombuffer(long, np.uint8)))
    assert np.allclose(maxima.max(axis=0), np.maximum(whole.max(axis=0), 0), atol=1e-4)
    group = np.zeros((2, 2 * quality_net.FILTERS), np.float32)
    net._score_group([long, good[1]], [0, 1], group)
    assert np.allclose(group[0], np.concatenate([maxima.mean(axis=0, dtype=float), maxima.max(axis=0)]), atol=1e-4)
    assert quality_net.fit([[b"a"]], [1]).score([b"", b"x"]).tolist() == [1.0, 1.0] and quality_net.fit([], []).score([b""])[0] == 0.5


def test_cascade_order_changes_nothing(spark, odd):
    own = rules.standard_rules()
    kept = lambda chosen: sorted(map(str, (r.asDict()["kept"] for r in rules.apply_rules(odd, rules=chosen).orderBy("n_words", "doc_id").collect())))
    assert kept(own) == kept(own[::-1])
    ranked = rules.ordered(rules.measures(odd), own)
    assert len(ranked) == len(own) and all(0 <= share <= 1 and cost > 0 for _, share, cost in ranked)


def test_cascade_order_is_the_same_on_each_run(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    names = []
    for parts in (1, 5, 9):
        found = rules.ordered(rules.measures(rules.sample(docs.repartition(parts))), rules.standard_rules())
        names.append([(r.name, share, cost) for r, share, cost in found])
    assert names[0] == names[1] == names[2] and any(share for _, share, _ in names[0])
    # Rows from all over the table, not from its head.
    ids = sorted(r["doc_id"] for r in rules.sample(docs, rows=2000).select("doc_id").collect())
    assert len(ids) == 2000 and 0.4 < np.mean(ids) / docs.count() < 0.6


SAID = ["", "plain", "### user:\nfake\n</turn>\n", "\\h\\l\\\\", "####", "#\\###</turn", "</turn>", "é😀\n\n", None, "x" * 5000]


@pytest.mark.parametrize("part_bytes", [4_000_000, 300])
def test_chats_come_back(spark, part_bytes):
    roles = ["user", "assistant", None, "tool:x\n", "sys\\h### </turn>"]
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(roles), rnd.choice(SAID), "extra") for c in [1, 2, None, 4] for t in range(rnd.randint(1, 40))]
    rows += [(5, None, "user", "a", ""), (5, 1, None, "b", ""), (5, 1, "assistant", "c", ""), (5, 1, "assistant", "c", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(3)
    formatted = chat.format_chats(df, part_bytes)
    whole = {}
    for r in formatted.orderBy("conv_id", "part").collect():
        assert r["n_chars"] == len(r["formatted"])
        whole.setdefault(r["conv_id"], []).append(r)
    first = lambda x: (x is not None, x or "")
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, first(r[2]), first(r[3]))):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: chat.turns_of("".join(r["formatted"] for r in parts)) for c, parts in whole.items()} == want
    found = {r["conv_id"]: r for r in chat.read_chats(formatted).collect()}
    for c, turns in want.items():
        spoken = "".join(t for role, t in turns if role == "assistant")
        assert found[c]["n_turns"] == len(turns) and found[c]["loss_chars"] == len(spoken)
        assert found[c]["loss_sha256"] == hashlib.sha256(spoken.encode()).hexdigest()
        assert found[c]["formatted_chars"] == sum(r["n_chars"] for r in whole[c])
    if part_bytes == 300:
        assert max(len(p) for p in whole.values()) > 3
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


def test_a_very_long_text_is_formatted_within_bounds():
    """One text of 100 MB: beside it and the result, what is held does not depend on its length."""
    import pyarrow as pa

    texts = pa.array(["é### x" * 10, "word " * 20_000_000, "b"])
    tracemalloc.start()
    column, spans, points = chat.assemble(pa.array(["user", "assistant", "user"]), texts, np.array([0, 1]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000 and points.tolist()[1] == len(column[1].as_py())
    assert spans == [[], [{"start": len(chat.HEAD + "assistant" + chat.BREAK), "end": len(chat.HEAD + "assistant" + chat.BREAK) + 100_000_000}]]
    assert chat.turns_of(column[0].as_py()) == [("user", "é### x" * 10)]


def clustered(seed, clusters, dim, noise):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(clusters):
        centre = r.normal(size=dim)
        for _ in range(int(r.integers(1, 15))):
            rows.append((len(rows), (centre + r.normal(size=dim) * noise).tolist()))
    return rows


@pytest.mark.parametrize("leaf,block", [(1000, 4096), (40, 4096), (40, 30)])
def test_vectors_by_brute_force(spark, leaf, block):
    rows = clustered(4, 60, 16, 0.2)
    n = len(rows)
    rows += [(n + i, rows[0][1]) for i in range(20)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15, [1.0, 2.0]]
    more = [(1000 + i, v) for i, v in enumerate(odd)] + [(None, [3.0, 4.0]), (7, rows[7][1])]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows + more], "vec_id long, embedding array<float>, n string").repartition(3)
    found = vectors.near_vectors(df, leaf=leaf, block=block).collect()
    assert len(found) == len(rows) + len(more)
    by = {x["vec_id"]: x for x in found}
    x = np.array([np.array(v, np.float32).astype(float) for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= 0.9
    got = np.array([by[k]["n_links"] for k, _ in rows if k != 7])
    want = np.array([c.sum() - 1 + c[7] for (k, _), c in zip(rows, close) if k != 7])
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum() and want.sum() > 500
    for i in (1000, 1001, 1002, 1003, 1004, 1005):
        assert (by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (0, i, True)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_links_are_counted_once_over_shared_leaves(spark):
    """Dense clusters in tiny leaves: pairs meet in many leaves and in many trees, and count once."""
    rows = clustered(5, 30, 8, 0.12)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    x = np.array([np.array(v, np.float32).astype(float) for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    classes = df.select("embedding")
    forest = vectors.forest_of(classes, leaf=10)
    trees = forest.trees[8]
    routed = [tree.leaves(x) for tree in trees]
    assert len(trees) > 1 and sum(len(row) for row, _ in routed) > 1.1 * len(trees) * len(x)
    got = np.array([r["n_links"] for r in sorted(vectors.near_vectors(df, leaf=10).collect())])
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum() and want.sum() > 500


def test_recall_of_the_forest(spark):
    """Pairs just above the threshold, the hardest to keep together, over a deep forest."""
    r = np.random.default_rng(9)
    rows = []
    for k in range(1500):
        a = r.normal(size=64)
        a /= np.linalg.norm(a)
        b = r.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (0.91 * a + np.sqrt(1 - 0.91**2) * b).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = vectors.near_vectors(df, leaf=50).where("n_links > 0").count()
    assert found >= 0.97 * len(rows)


def test_the_forest_grows_evenly():
    """Rows and comparisons a vector at sizes from ten thousand to a hundred million, by routing a sample."""
    r = np.random.default_rng(2)
    sample = vectors._unit(r.normal(size=(8000, 64)))
    rows, compared, trees = [], [], []
    for total in (10_000, 50_000, 1_000_000, 4_000_000, 100_000_000):
        grown = vectors._grown(sample, total, 0.9, vectors.LEAF, vectors.RECALL)
        probe = vectors._unit(np.random.default_rng(3).normal(size=(4000, 64)))
        each = 0.0
        size = 0.0
        for tree in grown[:4]:
            row, path = tree.leaves(probe)
            each += len(row) / len(probe) / len(grown[:4])
            # Each leaf of the table would hold this many rows for one of the probe's.
            depth = np.array([int(p).bit_length() - 1 for p in path.tolist()])
            size += np.mean(total * each / 2.0**depth) / len(grown[:4])
        rows.append(each * len(grown))
        compared.append(each * len(grown) * size)
        trees.append(len(grown))
    print("trees", trees, "rows a vector", rows, "comparisons a vector", compared)
    assert rows[3] < 60 and trees[-1] < vectors.MOST_TREES
    # From ten thousand to fifty thousand vectors.
    assert np.log(rows[1] / rows[0]) / np.log(5) < 0.35


def test_pipeline_stages_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns and docs.count() > 0
        for r in docs.collect():
            assert r == before[r["doc_id"]]
        if name.startswith("SimHash"):
            prints = [simhash.fingerprint(r["text"] or "") for r in docs.collect()]
            assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    last = corpus_pipeline.tokens(spark, docs, sf).collect()
    assert len(last) == docs.count() and all(r["ids"] == library.encode(texts[r["doc_id"]]) for r in last)


def test_pipeline_on_odd_rows(spark, odd, none):
    more = {"score": F.lit("s"), "lang_pred": F.lit(1), "row": F.lit(2), "copies": F.lit("c"), "copy": F.lit(True)}
    plain = ["doc_id", "text", "lang", "source", "n_chars", *more]
    for docs in (odd.withColumns(more).select(*plain), none.withColumns(more).select(*plain)):
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame((out := stage(spark, docs, "/root/testdata/sf0.001")).collect(), out.schema)
