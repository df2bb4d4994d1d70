"""License scan, media columns, BPE, language identification."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from piiframe.llm import bpe, langid, licenses, media

from .conftest import ROWS


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- license scan


def brute_scan(text):
    import re

    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base))


@pytest.mark.parametrize(
    "text, labels",
    [
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0,gpl"),
        ("is this, licensed under the gnu general public license 3", "GPL-3.0,gpl"),
        ("licensed under the gnu general lesser public license 3", ""),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,cc-by"),
        ("the MIT License the mit license", "mit"),
        ("released under the terms of the MIT license", "MIT,mit"),
        ("released under the terms of MIT license", "mit"),
        ("Apache License", "apache"),
        ("Licensed under the Apache License, Version 2.0", "Apache-2.0,apache"),
        ("", ""),
    ],
)
def test_labels(text, labels):
    assert licenses.Scanner().scan(text.encode())[5] == labels


@pytest.mark.parametrize("label, markup", [(k, m) for k, ms in licenses.TEMPLATES.items() for m in ms])
def test_every_template_takes_its_wording_and_no_other(label, markup):
    """With optional regions and without, and any words in replaceable regions; one mandatory word
    changed, or a replaceable region too long, and the template is not found."""
    import re

    scanner = licenses.Scanner(templates={label: [markup]})
    with_all = re.sub("<<(begin|end)Optional>>", " ", markup)
    without, n = markup, 1
    while n:
        without, n = re.subn("<<beginOptional>>(?:(?!<<beginOptional>>|<<endOptional>>).)*<<endOptional>>", " ", without)
    filled = lambda t, k: re.sub(r"<<var;name=\w+;max=(\d+)>>", lambda m: " any" * (k if k >= 0 else int(m[1]) - k - 1), t)
    found = lambda t: scanner.scan(f"Before. {t.title()}, after".encode())[5].split(",")
    for text in (filled(with_all, 1), filled(without, 1), filled(without, 0), filled(with_all, -1)):
        assert label in found(text)
    if "<<var" in without:
        assert label not in found(filled(without, -3))
    words = filled(without, 0).split()
    for at in range(0, len(words), max(1, len(words) // 12)):
        if licenses.words(words[at].encode()):
            assert label not in found(" ".join([*words[:at], "otherword", *words[at + 1 :]]))
    assert label in licenses.Scanner().scan(filled(without, 0).encode())[5].split(",")


def test_gate_holds_a_word_of_every_template():
    gate = licenses.gate(licenses.TEMPLATES)
    for markups in licenses.TEMPLATES.values():
        for m in markups:
            assert set(licenses.mandatory(m)) & set(gate)
    odd = {"x": ["<<beginOptional>>only<<endOptional>>"], "y": ["a b"]}
    assert licenses.gate(odd) == [] and licenses.gate({"y": ["a b"], "z": ["b c"]}) and licenses.gate({}) == []


@given(st.lists(st.sampled_from("mit license Mit gnu general public cc by apache é x 9 - . \n".split(" ")), max_size=40))
@settings(max_examples=200, deadline=None)
def test_phrases_against_brute_force(parts):
    text = " ".join(parts)
    assert licenses.Scanner().scan(text.encode())[:5] == brute_scan(text)


@given(st.lists(st.sampled_from("a b c d".split()), max_size=12))
@settings(max_examples=300, deadline=None)
def test_automaton_against_expression(parts):
    import re

    automaton = licenses.Automaton({"x": ["a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> <<var;name=v;max=2>> d"]})
    found = automaton.search([p.encode() for p in parts])
    assert bool(found) == bool(re.search(r" a (b (c )?)?(\S+ ){0,2}d ", " " + " ".join(parts) + " "))


def test_scan_rows(clashing, none):
    got = rows(licenses.scan(clashing))
    assert len(got) == len(ROWS)
    want = sorted((str(d), *map(str, brute_scan(t))) for d, t, _, _ in ROWS)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    assert sorted(tuple(str(r[n]) for n in names) for r in got) == want
    assert licenses.scan(none).count() == 0


# --- media columns


def test_media_rows(clashing, none):
    got = rows(media.columns(clashing))
    assert len(got) == len(ROWS)
    want = {}
    for d, t, _, _ in ROWS:
        data = (t or "").encode()
        payload = data + bytes((-len(data)) % 64 if data else 64)
        want.setdefault(d, []).append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    for r in got:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"]]
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert r["media"][:4] == b"RIFF" and media.read(bytes(r["media"])).startswith(b"" if r["n_bytes"] == 0 else b"")
        assert r["n_pairs"] == len(r["pairs"])
        assert r["feature"] == hashlib.sha256(np.array(r["pairs"], "<i8").tobytes()).hexdigest()
    assert media.columns(none).count() == 0


def test_peaks_against_brute_force():
    rng = np.random.default_rng(4)
    samples = rng.integers(0, 256, 6000).astype(np.uint8)
    old = media.SPAN
    media.SPAN = 7  # many spans must not change the result
    try:
        t, f = media.peaks(samples)
    finally:
        media.SPAN = old
    n = -(-(len(samples) - media.FRAME) // media.HOP) + 1
    level = media.spectrum(samples, 0, n)[:, 1:]
    want = []
    for i in range(n):
        for j in range(level.shape[1]):
            near = level[max(0, i - media.NEAR_FRAMES) : i + media.NEAR_FRAMES + 1, max(0, j - media.NEAR_BINS) : j + media.NEAR_BINS + 1]
            if level[i, j] == near.max() and level[i, j] > media.OVER_MEAN * level[i].mean() and level[i, j] > 1:
                want.append((i, j + 1))
    assert list(zip(t.tolist(), f.tolist())) == want and want
    pairs = []
    for i, (a, x) in enumerate(want):
        later = [(b, y) for b, y in want if b > a][: media.FAN]
        pairs += [(a << 32) | (x << 16) | (y << 8) | (b - a) for b, y in later if b - a <= media.SOON]
    assert media.pairs(t, f).tolist() == sorted(pairs)


def test_a_tone_is_found():
    samples = (128 + 100 * np.sin(2 * np.pi * 1000 * np.arange(8000) / media.RATE)).astype(np.uint8)
    _, f = media.peaks(samples)
    assert set(f.tolist()) == {1000 * media.FRAME // media.RATE}
    assert len(media.features(bytes([7]) * 640)) == 0


# --- BPE


@pytest.fixture(scope="module")
def codecs():
    import public_tokenizers
    import tiktoken

    own = bpe.encoder(bpe.VOCABULARY, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@given(st.text(alphabet=st.sampled_from("abcdefghe AB'12é ß\n\t\x1c\x85　漢字😀.,!-ſthe ing on"), max_size=80) | st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_library(codecs, text):
    own, library = codecs
    ids = own.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_bpe_long_pieces_and_full_cache(codecs):
    own, library = codecs
    draw = np.random.default_rng(5)
    letters = lambda first, last, n: "".join(map(chr, draw.integers(first, last + 1, n)))
    texts = ["ab" * 2000 + "the" * 300, "!" * 300 + " " * 500 + "x", "z" * 255, "z" * 257, "z" * 3001, "The quick brown foxes", "漢字仮名" * 500, letters(0x4E00, 0x9FFF, 3000), letters(97, 122, 20000), letters(0xE0, 0xF6, 4000)]
    small = bpe.BytePairEncoder(own.ranks, own.pattern.pattern, cached=0)
    for encoder in (own, small):
        for text, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    small.cached = 1
    small.encode(["a b c"])
    assert [np.frombuffer(x, "<u4").tolist() for x in small.encode(["c a d"])] == [library.encode_ordinary("c a d")]


def test_row_of_any_vocabulary():
    """Vocabularies in which a longer token may have the smaller rank, against merges one by one."""
    draw = np.random.default_rng(6)
    for _ in range(60):
        tokens = [bytes([c]) for c in b"abcd"] + sorted({bytes(draw.choice(list(b"abcd"), draw.integers(2, 6)).tolist()) for _ in range(60)})
        order = draw.permutation(len(tokens))
        own = bpe.BytePairEncoder({t: int(i) for t, i in zip(tokens, order)}, r"\S+|\s+")
        for _ in range(20):
            piece = bytes(draw.choice(list(b"abcd"), draw.integers(2, 40)).tolist())
            parts = [bytes([c]) for c in piece]
            while True:
                best = min(((own.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in own.ranks), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            want = [own.ranks[p] for p in parts]
            assert np.frombuffer(own.merge_row(piece), "<u4").tolist() == want
            assert np.frombuffer(own.merge_rows([piece], len(piece))[0], "<u4").tolist() == want


def test_bpe_rows(codecs, clashing, none):
    _, library = codecs
    got = rows(bpe.round_trip(clashing))
    want = []
    for d, t, _, _ in ROWS:
        ids = library.encode_ordinary(t or "")
        want.append((str(d), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want)
    assert bpe.round_trip(none).count() == 0
    back = rows(bpe.decode(bpe.encode(clashing)))
    assert sorted((str(r["doc_id"]), bytes(r["data"])) for r in back) == sorted((str(d), (t or "").encode()) for d, t, _, _ in ROWS)


# --- language identification


def test_langid_held_out_accuracy(documents):
    out = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(out) == documents.count()
    held = out[out.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.95
    assert out.score.between(0, 1).all()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()


def test_langid_rows(clashing, none):
    got = rows(langid.identify(clashing))
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    for i in (2, 3, 4, 5):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[7]["lang_pred"] in ("en", "fr", "de", "ja") and all(0 <= r["score"] <= 1 for r in got)
    assert not by[None]["held_out"]
    assert langid.identify(none).count() == 0
    blank = clashing.withColumn("lang", clashing["lang"].substr(1, 0)).where("doc_id = 1")
    assert langid.identify(blank).count() == 1


def test_spans_of_a_long_text_do_not_matter():
    text = "The élan of ça va, über 12 und, " * 50
    whole = langid.counts(text)
    old = langid.SPAN
    try:
        langid.SPAN = 37
        assert (langid.counts(text) == whole).all()
    finally:
        langid.SPAN = old


def test_nothing_to_learn(odd):
    out = rows(langid.predict(odd.select("doc_id", "text"), langid.Model()))
    assert {(r["lang_pred"], r["score"]) for r in out} == {("und", 0.0)}


def test_many_languages_get_fewer_rows_each(spark):
    """90 labels: all are learned, from few rows each."""
    draw = np.random.default_rng(2)
    rows_ = []
    for k in range(90):
        alphabet = [chr(0x4E00 + 40 * k + int(j)) for j in draw.choice(40, 8, replace=False)]
        rows_ += [(100 * k + i, "".join(draw.choice(alphabet + [" "], 80)), f"l{k:02}") for i in range(14)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    model = langid.learn(docs, per_lang=400, rows=900)
    assert sorted(x for _, members in model.families for x in members) == [f"l{k:02}" for k in range(90)]


def brute_svm(rows_, sign, cost):
    """The primal problem by plain subgradient steps."""
    w = np.zeros(rows_.shape[1] + 1)
    both = np.hstack([rows_, np.ones((len(rows_), 1))])
    best, least = w, np.inf
    for t in range(1, 40001):
        margin = sign * (both @ w)
        value = 0.5 * w @ w + cost * np.maximum(0, 1 - margin).sum()
        if value < least:
            best, least = w, value
        w = w - 0.5 / t * (w - cost * (sign * (margin < 1)) @ both)
    return best, least


def test_svm_against_brute_force():
    draw = np.random.default_rng(9)
    for _ in range(3):
        x = draw.normal(size=(40, 5))
        sign = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.6 * draw.normal(size=40) > 0, 1.0, -1.0)
        w = langid.fit_svm(x, sign, cost=1.0, rounds=400)
        value = lambda v: 0.5 * v @ v + np.maximum(0, 1 - sign * (x @ v[:-1] + v[-1])).sum()
        assert value(w) <= brute_svm(x, sign, 1.0)[1] * 1.01 + 1e-6


def test_choice_is_hierarchical():
    """Family first, then votes of that family's machines alone, counted by hand."""
    draw = np.random.default_rng(10)
    langs = ["de", "en", "nl", "es", "fr", "ru"]
    texts = {x: ["".join(draw.choice([chr(97 + (5 * k + j) % 26) for j in range(9)] + [" "], 60)) for _ in range(12)] for k, x in enumerate(langs)}
    frequency = lambda t: langid.counts(t) * (langid.SCALE / langid.counts(t).sum())
    model = langid.Model.fit([x for x in langs for _ in texts[x]], np.array([frequency(t) for x in langs for t in texts[x]], np.float32))
    assert [f for f, _ in model.families] == ["germanic", "romance", "slavic"]
    for t in ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz "), 50)) for _ in range(60)]:
        margin = frequency(t) @ model.weights.astype(float) + model.bias
        best = int(np.argmax(margin[:3]))
        members, votes = model.families[best][1], Counter()
        for (f, a, b), m in zip(model.pairs, margin[3:]):
            if f == best:
                votes[members[a] if m >= 0 else members[b]] += 1
        lang, score = model.predict(t)
        assert lang in members and votes[lang] == max(votes.values(), default=0) and 0 <= score <= 1
