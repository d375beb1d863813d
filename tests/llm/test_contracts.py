"""The operator queries over the smallest driver tables against brute force in plain Python."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash

from skillgap.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in table(spark, SF, "documents").collect()}


def rows(spark, name, key="doc_id"):
    found = QUERIES[name](spark, SF).collect()
    by = {r[key]: r.asDict() for r in found}
    assert len(by) == len(found)
    return by


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1_equals_the_library(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = rows(spark, "op1_sentencepiece")
    assert found.keys() == documents.keys()
    for k, d in documents.items():
        ids = library.encode(d["text"] or "")
        assert found[k]["n_tokens"] == len(ids)
        assert found[k]["ids_sha256"] == sha(",".join(map(str, ids)))
        assert found[k]["decoded_sha256"] == sha(library.decode(ids))


def test_op3_stays_near_targets(spark, documents):
    found = rows(spark, "op3_mixing")
    assert found.keys() == documents.keys()
    by_source: dict = {}
    for k, r in found.items():
        assert r["size"] == len(WORD.findall(documents[k]["text"] or ""))
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_source.setdefault(documents[k]["source"], []).append(r)
    total = sum(r["size"] for r in found.values())
    assert sum(v[0]["target"] for v in by_source.values()) == pytest.approx(total)
    for own in by_source.values():
        size = sum(r["size"] for r in own)
        assert own[0]["source_size"] == size and own[0]["target"] <= 3 * size
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2 * max(r["size"] for r in own)
    assert rows(spark, "op3_mixing") == found


def test_op1_compares_whole_texts(spark, monkeypatch):
    """A codec whose decoded texts are wrong is found out by the library."""
    from skillgap.llm import pieces
    from skillgap.llm.queries import model_path

    codec = pieces._codec(pieces.read_model(model_path()))
    monkeypatch.setattr(codec, "_shown", lambda surface: surface + "!")
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words here"]})
    with pytest.raises(ValueError):
        list(pieces.encode_batches(pieces.read_model(model_path()), "text", False, False)(iter([batch])))
    pieces._codecs.clear()


@pytest.mark.parametrize("place", [1, 6, 11, 299])
@pytest.mark.parametrize("spoilt", ["ids", "decoded"])
def test_op1_compares_each_whole_text(monkeypatch, place, spoilt):
    """Ids or a decoded text that are wrong in any one row are found out."""
    import pyarrow as pa

    from skillgap.llm import pieces
    from skillgap.llm.queries import model_path

    model = pieces.read_model(model_path())
    codec = pieces._codec(model)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "text": [f"some words in row {i}" for i in range(300)]})
    run = pieces.encode_batches(model, "text", False, False)
    assert sum(b.num_rows for b in run(iter([batch]))) == 300
    encode_all = codec.encode_all

    def wrong(texts):
        found = encode_all(texts)
        for i, t in enumerate(texts):
            if t == f"some words in row {place}":
                ids, decoded = found[i]
                found[i] = (ids + ",7", decoded) if spoilt == "ids" else (ids, decoded + "!")
        return found

    monkeypatch.setattr(codec, "encode_all", wrong)
    with pytest.raises(ValueError):
        list(run(iter([batch])))
    pieces._codecs.clear()


def test_op4_base_by_search(spark, documents):
    find = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    found = rows(spark, "op4_licenses")
    for k, d in documents.items():
        words = find(re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or ""))
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = found[k]
        assert r["n_words"] == len(words) and r["n_base"] == len(places)
        assert r["first_word"] == min((i for i, _ in places), default=None)
        assert r["last_word"] == max((i for i, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def brute_print(text: str) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op5_by_all_pairs(spark, documents):
    found = rows(spark, "op5_simhash")
    prints = {k: brute_print(d["text"] or "") for k, d in documents.items()}
    root = {k: k for k in prints}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    for k in prints:
        assert found[k]["fingerprint"] == f"{prints[k]:016x}"
        assert found[k]["component_id"] == top(k)


def test_op6_held_out_accuracy(spark, documents):
    found = QUERIES["op6_langid"](spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r["held_out"] and lang[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_op7_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in QUERIES["op7_quality_net"](spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in found.items())
    held = [(found[r["doc_id"]], r["quality"]) for r in table(spark, sf, "labels").collect() if found[r["doc_id"]]["held_out"]]
    assert np.mean([p["predicted"] == q for p, q in held]) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in found.values())


def test_op9_reads_back_every_turn(spark):
    turns: dict = {}
    for r in table(spark, SF, "conversations").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    said = "\\### Assistant: </turn> ok"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    found = rows(spark, "op9_chat", "conv_id")
    assert found.keys() == turns.keys()
    for k, own in turns.items():
        own.sort()
        spoken = "".join(t for _, role, t in own if role == "assistant")
        assert found[k]["n_turns"] == len(own)
        assert found[k]["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in own))
        assert found[k]["loss_chars"] == len(spoken) and found[k]["loss_sha256"] == sha(spoken)


def test_op10_by_all_pairs(spark, tmp_path):
    """The query over the sf0.01 table, which has no links, beside vectors that have, so that the forest is several levels deep."""
    own = {r["vec_id"]: r["embedding"] for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect()}
    r = np.random.default_rng(7)
    for i, v in enumerate(list(own.values())[:300]):
        v = np.array(v)
        for k in range(int(r.integers(1, 5))):
            own[100_000 + 10 * i + k] = (v + r.normal(size=len(v)) * np.abs(v).mean() * r.uniform(0.05, 0.5)).tolist()
    spark.createDataFrame(list(own.items()), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    ids = sorted(own)
    x = np.array([own[k] for k in ids], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= 0.9
    found = {r["vec_id"]: r for r in QUERIES["op10_embeddings"](spark, str(tmp_path)).collect()}
    want = close.sum(axis=1) - 1
    got = np.array([found[k]["n_links"] for k in ids])
    assert (got <= want).all() and got.sum() >= 0.97 * want.sum() and want.sum() > 500
    root = {k: k for k in ids}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in zip(*np.nonzero(np.triu(close, 1))):
        p, q = top(ids[a]), top(ids[b])
        root[max(p, q)] = min(p, q)
    assert np.mean([found[k]["component_id"] == top(k) for k in ids]) > 0.99
    assert all(found[k]["kept"] == (found[k]["component_id"] == k) for k in ids)
