"""The two fitted models against plain Python: mixtures by expectation maximisation, and the network's gradient."""

from __future__ import annotations

import math

import numpy as np
import pytest

from skillgap.llm import langid, quality_net
from skillgap.llm.queries import table


def plain_trigrams(text: str) -> list[int]:
    """Buckets of the trigrams, by hand."""
    letters = [b if b >= 128 else b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in text.encode()]
    run = [32]
    for b in [*letters, 32]:
        if b != 32 or run[-1] != 32:
            run.append(b)
    return [((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 17 for a, b, c in zip(run, run[1:], run[2:])]


def plain_em(rows, share):
    likelihood = lambda: sum(math.log(sum(p * s for p, s in zip(row, share))) for row in rows)
    if len(share) > 1:
        for _ in range(langid.ROUNDS):
            after = [0.0] * len(share)
            for row in rows:
                whole = sum(p * s for p, s in zip(row, share))
                for k, (p, s) in enumerate(zip(row, share)):
                    after[k] += p * s / whole
            after = [a / len(rows) for a in after]
            moved = max(abs(a - s) for a, s in zip(after, share))
            share = after
            if moved < 1e-3:
                break
    return share, likelihood()


def plain_mixture(text, texts_by_lang):
    names = sorted(texts_by_lang)
    counts = {n: [0.5] * langid.BUCKETS for n in names}
    for n in names:
        for t in texts_by_lang[n]:
            for b in plain_trigrams(t):
                counts[n][b] += 1
    sums = {n: sum(counts[n]) for n in names}
    rows = [[counts[n][b] / sums[n] for n in names] for b in plain_trigrams(text)]
    share, _ = plain_em(rows, [1 / len(names)] * len(names))
    order = sorted(range(len(names)), key=lambda k: (-share[k], k))
    best, out = -math.inf, share
    for size in range(1, len(names) + 1):
        chosen = order[:size]
        if size > 1 and share[chosen[-1]] < 1e-3:
            break
        total = sum(share[k] for k in chosen)
        part, likelihood = plain_em([[r[k] for k in chosen] for r in rows], [share[k] / total for k in chosen])
        value = likelihood - (size - 1) * langid.PENALTY * math.log(len(rows))
        if value <= best:
            break
        best, out = value, [0.0] * len(names)
        for k, s in zip(chosen, part):
            out[k] = s
    return dict(zip(names, out))


def test_mixtures_by_plain_python(spark):
    docs = [r for r in table(spark, "/root/testdata/sf0.001", "documents").collect() if r["text"] and r["lang"]]
    own: dict = {}
    for r in docs:
        if len(own.setdefault(r["lang"], [])) < 6 and len(r["text"]) < 4000:
            own[r["lang"]].append(r["text"])
    rows = [(t, lang) for lang, texts in own.items() for t in texts]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    short = [r["text"] for r in docs if 30 < len(r["text"]) < 700][:12]
    halves = [a[:300] + " " + b[:300] for a, b in zip([own[x][0] for x in sorted(own)], [own[x][1] for x in sorted(own)[1:]])]
    cases = short + halves + ["x", "Straße 12"]
    found = langid.mixtures(spark.createDataFrame(list(enumerate([*cases, None, "", " 12 "])), "i int, text string"), model).collect()
    by = {r["i"]: r["languages"] for r in found}
    for i, text in enumerate(cases):
        want = plain_mixture(text, own)
        got = {m["lang"]: m["share"] for m in by[i]}
        assert {k for k, v in want.items() if v > 0} == set(got)
        assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)
        assert [m["share"] for m in by[i]] == sorted((m["share"] for m in by[i]), reverse=True)
    assert max(len(by[i]) for i in range(len(cases))) > 1
    assert by[len(cases)] == by[len(cases) + 1] == by[len(cases) + 2] == []


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError):
        langid.learn(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "text string, lang string"))


def plain_loss(parts, chunks, labels):
    """The mean loss, place by place, in double precision."""
    embed, filters, bias, out, shift = parts
    loss = 0.0
    size = (quality_net.CHUNK - 1) * quality_net.STRIDE + quality_net.WIDTH
    for own, label in zip(chunks, labels):
        tops = []
        for c in own:
            data = list(c) + [quality_net.PAD] * (size - len(c))
            best = np.full(quality_net.FILTERS, 0.0)
            for start in range(0, len(data) - quality_net.WIDTH + 1, quality_net.STRIDE):
                x = np.concatenate([embed[b] for b in data[start : start + quality_net.WIDTH]])
                best = np.maximum(best, x @ filters + bias)
            tops.append(best)
        z = float(np.concatenate([np.mean(tops, axis=0), np.max(tops, axis=0)]) @ out + shift[0])
        loss += math.log1p(math.exp(-z)) if label else math.log1p(math.exp(z))
    return loss / len(labels) + 0.5e-4 * float(out @ out)


def test_the_fit_goes_down_the_gradient():
    """The first step of the fit has the sign of the gradient by differences, for parameters of every kind."""
    r = np.random.default_rng(3)
    texts = [bytes(r.integers(97, 123, 700, dtype=np.uint8)) for _ in range(3)] + [b"## $$ 11 " * 40, b"", b"\xc3\xa9" * 90]
    chunks, labels = [quality_net.spread_chunks(t) for t in texts], [1, 1, 1, 0, 0, 0]
    before = [p.astype(np.float64) for p in quality_net.Network(7).parts()]
    after = quality_net.fit(chunks, labels, seed=7, epochs=1).parts()
    seen = sorted({b for t in texts for b in t})
    checked = 0
    for k, p in enumerate(before):
        flat = [int(i) for i in r.choice(p.size, min(p.size, 14), replace=False)]
        if k == 0:  # rows of the table that the texts use
            flat = [b * quality_net.DIM + int(r.integers(quality_net.DIM)) for b in [*seen[:10], quality_net.PAD]]
        for i in flat:
            values = []
            for move in (1e-4, -1e-4):
                parts = [q.copy() for q in before]
                parts[k].ravel()[i] += move
                values.append(plain_loss(parts, chunks, labels))
            slope = (values[0] - values[1]) / 2e-4
            moved = float(after[k].ravel()[i]) - float(p.ravel()[i])
            if abs(slope) > 1e-5:
                assert moved == pytest.approx(-0.01 * math.copysign(1, slope), rel=0.02), (k, i, slope, moved)
                checked += 1
    assert checked > 40
