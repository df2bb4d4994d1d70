"""SimHash classes, substring dedup, packing, sharding, neighbour search, WARC, pipeline."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from piiframe.llm import ann, packing, sharding, simhash, subdedup, warc

from .conftest import LONG, ROWS


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- SimHash


def brute_fingerprint(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(codes, radius, groups=None):
    label = list(range(len(codes)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (groups is None or groups[i] == groups[j]) and bin(codes[i] ^ codes[j]).count("1") <= radius:
                label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(codes))]


@given(st.text(alphabet=st.sampled_from("abAB é\t\n\x1c\x85"), max_size=60) | st.sampled_from([LONG[:4000]]))
@settings(max_examples=100, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) % 2**64 == brute_fingerprint(text)


@pytest.mark.parametrize("seed", range(12))
def test_index_against_all_pairs(seed):
    draw = np.random.default_rng(seed)
    n, radius = int(draw.integers(1, 300)), int(draw.integers(0, 7))
    base = draw.integers(0, 2**63, size=4).astype(np.uint64)
    code = base[draw.integers(0, 4, n)]
    for i in range(n):
        for b in draw.integers(0, 64, draw.integers(0, 6)):
            code[i] ^= np.uint64(1) << np.uint64(b)
    code = np.unique(code)
    group = np.sort(draw.integers(0, 3, len(code)))
    a, b = simhash.GrayIndex(group, code).forest(radius)
    assert len(a) < max(1, len(code))  # a forest, not all pairs
    label = np.arange(len(code))
    simhash._join(label, np.asarray(a), np.asarray(b))
    assert label.tolist() == brute_components(code.tolist(), radius, group.tolist())


@pytest.mark.parametrize("most, deepest", [(1 << 17, 3), (20, 3), (20, 1)])
def test_forest_with_hot_files(spark, most, deepest):
    """Files of over 20 codes are filed again, or split into blocks that meet two by two."""
    draw = np.random.default_rng(3)
    code = np.unique(np.concatenate([np.int64(5) ^ (np.int64(1) << draw.integers(0, 40, (200, 6))).sum(1), draw.integers(-(2**62), 2**62, 200)]))
    fps = spark.createDataFrame([(int(c), int(c)) for c in code], "id long, c_0 long")
    filing = simhash.Blocks(4)
    filing.deepest = deepest
    out = simhash.stars(simhash.forest(fps, filing, most=most)).collect()
    root = {r["node"]: r["root"] for r in out}
    mine = [root.get(c, c) for c in code.tolist()]
    want = brute_components([c % 2**64 for c in code.tolist()], 4)
    assert [mine.index(m) for m in mine] == [want.index(w) for w in want]


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.stars(links).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 100: 90}


def test_classes(clashing, none, documents):
    got = rows(simhash.classes(clashing))
    assert len(got) == len(ROWS)
    code = [brute_fingerprint(t) for _, t, _, _ in ROWS]
    part = brute_components(code, 4)
    least = {p: min((r[0] for r, q in zip(ROWS, part) if q == p and r[0] is not None), default=None) for p in part}
    want = sorted((str(r[0]), c, str(least[p])) for r, c, p in zip(ROWS, code, part))
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, str(r["component_id"])) for r in got) == want
    assert simhash.classes(none).count() == 0 and simhash.keep_one(none).count() == 0
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    texts = {}
    for d, t, _, _ in ROWS:  # none of these is near another but equal (or wordless) ones
        key = " ".join((t or "").lower().split())
        texts[key] = min(texts.get(key, 1 << 60), 1 << 60 if d is None else d)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(None if d == 1 << 60 else d for d in texts.values())
    own = simhash.classes(documents).toPandas()
    text = dict(documents.select("doc_id", "text").toPandas().itertuples(index=False))
    code = [brute_fingerprint(text[i]) for i in own.doc_id]
    part = brute_components(code, 4)
    least = {}
    for i, p in zip(own.doc_id, part):
        least[p] = min(i, least.get(p, i))
    assert own.component_id.tolist() == [least[p] for p in part]


@pytest.mark.parametrize("words", [2, 4])
def test_wide_index_against_all_pairs(words):
    draw = np.random.default_rng(words)
    base = draw.integers(0, 2**63, (5, words)).astype(np.uint64)
    code = base[draw.integers(0, 5, 200)]
    for row in code:
        for b in draw.integers(0, 64 * words, draw.integers(0, 12 * words)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    code = np.unique(code, axis=0)
    radius = 10 * words
    a, b = simhash.GrayIndex(np.zeros(len(code), int), code).forest(radius)
    label = np.arange(len(code))
    simhash._join(label, np.asarray(a), np.asarray(b))
    whole = [sum(int(w) << (64 * i) for i, w in enumerate(row)) for row in code]
    assert label.tolist() == brute_components(whole, radius)


def test_gray_order_steps_by_one_bit():
    codes = np.array([[i ^ (i >> 1), 0] for i in range(64)], np.uint64)
    assert simhash.gray_rank(codes)[:, 0].tolist() == list(range(64))
    low = np.array([[0, 0], [0, 1], [1, 1], [1, 0]], np.uint64)  # the low word turns back under an odd high word
    rank = simhash.gray_rank(low)
    assert [tuple(r) for r in rank.tolist()] == [(0, 0), (0, 1), (1, 2**64 - 2), (1, 2**64 - 1)]


@pytest.mark.parametrize("most", [1 << 17, 8])
def test_near_copies_go_and_others_stay(spark, most, monkeypatch):
    """With files of 8 codes at most, every group is split into blocks."""
    draw = np.random.default_rng(8)
    vocabulary = ["".join(draw.choice(list("abcdefghijk"), draw.integers(2, 9))) for _ in range(2000)]
    bases = [draw.choice(vocabulary, 300).tolist() for _ in range(60)]
    docs, groups = [], {}
    for g, base in enumerate(bases):
        for c in range(1 + 3 * (g % 2)):
            words = list(base)
            for at in draw.choice(300, 4 if c else 0, replace=False):  # 4 edits of 300 words: alike to 0.87 at least
                words[at] = "edited"
            groups[len(docs)] = g
            docs.append((len(docs), " ".join(words)))
    monkeypatch.setattr(simhash.forest, "__defaults__", (most,))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    first = {g: min(d for d, h in groups.items() if h == g) for g in groups.values()}
    assert set(first.values()) <= kept and len(kept) <= 62  # every group stays; a copy or two may be missed


def test_bands_find_what_is_alike():
    """Of pairs of sets alike to 0.8, at most a few in a thousand share no band; of unlike ones few do."""
    draw = np.random.default_rng(4)
    filing = simhash.Bands(0.8, 2, 40)
    miss = far = 0
    for _ in range(400):
        both, a, b = (draw.integers(0, 2**64, n, np.uint64) for n in (160, 20, 20))  # 160 of 200
        x, y = np.concatenate([both, a]), np.concatenate([both, b])
        miss += not set(enumerate(filing.sign(x))) & set(enumerate(filing.sign(y)))
        apart = sum(bin((u ^ v) % 2**64).count("1") for u, v in zip(simhash.wide_code(x, 2), simhash.wide_code(y, 2)))
        miss += apart > filing.radius
        far += bool(set(enumerate(filing.sign(a))) & set(enumerate(filing.sign(x[:100]))))
    assert miss <= 6 and far <= 4
    whole = draw.integers(0, 2**64, 5000, np.uint64)
    assert simhash.least_hashes(whole, filing.odd).tolist() == [min(int(h) * int(o) % 2**64 for h in whole) for o in filing.odd]


def alike_docs():
    """Texts of 60 bases with copies alike to 0.66 to 0.94, and of one chain of close copies."""
    draw = np.random.default_rng(12)
    vocabulary = ["".join(draw.choice(list("abcdefghijk"), draw.integers(2, 9))) for _ in range(4000)]
    docs = []
    for g in range(60):
        base = draw.choice(vocabulary, 250).tolist()
        for edits in (0, 2, 4, 5, 7, 9, 10):
            words = list(base)
            for at in draw.choice(np.arange(6, 240, 6), edits, replace=False):
                words[at] = f"edit{g}x{edits}x{at}"
            docs.append((len(docs), " ".join(words)))
    words = draw.choice(vocabulary, 250).tolist()
    for at in range(0, 240, 6):
        words[at] = f"chain{at}"
        docs.append((len(docs), " ".join(words)))
    return docs


def brute_alike(docs, alike=0.8):
    sets = []
    for _, t in docs:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = np.arange(len(docs))
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= alike * len(sets[i] | sets[j])]
    simhash._join(label, np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
    return {docs[i][0] for i in np.unique(label)}


@pytest.mark.parametrize("group_rows", [1 << 10, 6])
def test_links_are_confirmed_by_the_sets(spark, group_rows, monkeypatch):
    """With groups of 6 rows every component is dealt to several groups."""
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(simhash, "PIVOTS", 32 if group_rows > 6 else 1)
    docs = alike_docs()
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == brute_alike(docs)


# --- substring dedup


def test_chunks_fall_back_in_step():
    draw = np.random.default_rng(1)
    passage = " ".join("".join(draw.choice(list("abcdefgh"), 6)) for _ in range(60))
    a, b = (t.encode() for t in ("x" * 17 + " one " + passage + " tail", "other words before it " * 3 + passage + "."))
    ends = [subdedup.cuts(d).tolist() for d in (a, b)]
    pieces = [{d[i:j] for i, j in zip([0, *e], e)} for d, e in zip((a, b), ends)]
    assert sum(map(len, pieces[0] & pieces[1])) > 0.7 * len(passage)


@given(st.text(max_size=600) | st.binary(max_size=600).map(lambda b: b.decode("latin-1")) | st.just("漢字" * 900) | st.just("a" * 3000))
@settings(max_examples=200, deadline=None)
def test_cuts_cover_whole_characters(text):
    data = text.encode()
    ends = subdedup.cuts(data).tolist()
    assert ends == sorted(set(ends)) and (ends[-1:] == [len(data)] if data else not ends)
    for a, b in zip([0, *ends], ends):
        data[a:b].decode()
        assert b - a <= subdedup.MOST + 3
    spans = subdedup.remove(data, set(), 1)
    assert spans[0].decode() is not None


def passages(data, min_words):
    """Start and end of the shortest run of chunks from each chunk on, and up to each, that is long
    enough; the test's own count."""
    import unicodedata

    def size(part):
        total = 0
        for c in part.decode():
            name = unicodedata.name(c, "")
            total += 3 if "CJK" in name or name.startswith(("HIRAGANA", "KATAKANA")) or ord(c) > 0xFFFF else 2 if "HANGUL SYLLABLE" in name else 1
        return total

    ends = subdedup.cuts(data).tolist()
    starts, out = [0, *ends][: len(ends)], set()
    sizes = [size(data[a:b]) for a, b in zip(starts, ends)]
    for i in range(len(ends)):
        for j in range(i, len(ends)):
            if sum(sizes[i : j + 1]) >= 6.4 * min_words:
                out.add((starts[i], ends[j]))
                break
        for j in range(i, -1, -1):
            if sum(sizes[j : i + 1]) >= 6.4 * min_words:
                out.add((starts[j], ends[i]))
                break
    return sorted(out)


def brute_dedup(docs, min_words):
    """In the order of ids: a passage goes if its very text is one of an earlier document's
    passages, or of its own document's that ends before it."""
    out, earlier = [], {}
    for d in sorted({d for d, _ in docs if d is not None}):
        earlier[d] = {e: set() for e in ()}
    seen = set()
    for d in sorted(earlier):
        earlier[d] = set(seen)
        for e, t in docs:
            if e == d:
                data = (t or "").encode()
                seen |= {data[a:b] for a, b in passages(data, min_words)}
    for d, t in docs:
        data = (t or "").encode()
        found, gone = passages(data, min_words), set()
        for k, (a, b) in enumerate(found):
            if data[a:b] in earlier.get(d, ()) or any(data[x:y] == data[a:b] and y <= a for x, y in found[:k] if y - x == b - a):
                gone |= set(range(a, b))
        out.append((d, None if t is None else bytes(c for i, c in enumerate(data) if i not in gone).decode()))
    return out


def test_dedup(clashing, none, documents):
    new = ["cut_spans", "n_chunks", "n_cut"]
    got = subdedup.dedup(clashing.drop(*new), min_words=3)
    assert got.columns == clashing.drop(*new).columns + new
    key = lambda r: (str(r[0]), str(r[1]))
    short = [(d, t if t != LONG else None) for d, t, _, _ in ROWS]
    assert sorted(((r["doc_id"], r["text"]) for r in got.where("doc_id != 6 or doc_id is null").collect()), key=key) == sorted(((d, t) for d, t in brute_dedup(short, 3) if d != 6), key=key)
    left = got.where("doc_id = 6").first()["text"]
    assert LONG.startswith(left[:90]) and len(left) < 0.1 * len(LONG)  # of a text that repeats itself the first passages stay
    assert subdedup.dedup(clashing).columns == clashing.columns
    assert subdedup.dedup(none).count() == 0
    some = documents.select("doc_id", "text").where("length(text) < 6000")
    docs = [(r["doc_id"], r["text"]) for r in some.collect()]
    out = subdedup.dedup(some)
    found = rows(out)
    assert sorted((r["doc_id"], r["text"]) for r in found) == sorted(brute_dedup(docs, 15))
    assert any(r["n_cut"] for r in found)
    text = dict(docs)
    for r in found:  # what is left and what was cut make up the text
        data, at, left = text[r["doc_id"]].encode(), 0, b""
        for s in r["cut_spans"]:
            left += data[at : s["start"]]
            at = s["end"]
        assert (left + data[at:]).decode() == r["text"]


def test_pieces_of_several_documents_stay(spark):
    """Every 96 characters that go stand whole in one earlier document; text that is put together
    from short pieces of different ones stays."""
    draw = np.random.default_rng(21)
    word = lambda n: " ".join("".join(draw.choice(list("abcdefghijk"), draw.integers(2, 9))) for _ in range(n))
    base = [word(60) for _ in range(40)]
    mixed = []
    for i in range(100):
        parts = [base[j].split() for j in draw.choice(40, 6, replace=False)]
        mixed.append(" ".join(" ".join(p[k : k + 10]) for p in parts for k in [int(draw.integers(0, 50))]))
    docs = list(enumerate(base)) + [(100 + i, t) for i, t in enumerate(mixed)] + [(300, base[3] + " " + base[4])]
    out = {r["doc_id"]: r for r in subdedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    text = dict(docs)
    for i, r in out.items():
        for s in r["cut_spans"]:
            gone = text[i].encode()[s["start"] : s["end"]].decode()
            windows = [gone[k : k + 96] for k in range(0, len(gone) - 95)]
            assert len(gone) >= 96 and sum(any(w in t for j, t in docs if j < i) for w in windows[:1] + windows[-1:]) == 2
    assert sum(r["text"] != text[i] for i, r in out.items() if 100 <= i < 300) == 0
    assert len(out[300]["text"]) < 0.5 * len(text[300])


def test_planted_passages_go_and_the_rest_stays(spark):
    draw = np.random.default_rng(9)
    word = lambda n: " ".join("".join(draw.choice(list("abcdefghijk"), draw.integers(2, 9))) for _ in range(n))
    passages = [word(60) for _ in range(20)]
    docs = [(i, word(80) + ". " + passages[i % 20] + ". " + word(50)) for i in range(60)] + [(100 + i, word(120)) for i in range(20)]
    out = {r["doc_id"]: r["text"] for r in subdedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        if i < 20 or i >= 100:
            assert out[i] == t
        else:
            gone = len(t) - len(out[i])
            assert passages[i % 20] not in out[i] and 0.5 * len(passages[i % 20]) < gone <= len(passages[i % 20]) + 24


@pytest.mark.parametrize("first, last, gap", [(0x4E00, 0x9000, 0), (0x3041, 0x3096, 0), (0x0E01, 0x0E2E, 0), (0x0E01, 0x0E2E, 20), (0x4E00, 0x9000, 25), (97, 122, 0)])
def test_unspaced_passages_go(spark, first, last, gap):
    """Chinese, Japanese, Thai (with and without spaces between phrases) and long strings."""
    draw = np.random.default_rng(first + gap)

    def text(n):
        whole = "".join(map(chr, draw.integers(first, last + 1, n)))
        return " ".join(whole[i : i + gap] for i in range(0, n, gap)) if gap else whole

    passage = text(200)
    docs = [(1, text(300) + passage + text(200)), (2, text(250) + passage + text(300)), (3, text(400)), (4, text(500)), (5, "")]
    docs[4] = (5, docs[3][1])
    out = {r["doc_id"]: r["text"] for r in subdedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [out[i] for i in (1, 3, 4)] == [t for i, t in docs if i in (1, 3, 4)]
    assert out[5] == "" and passage not in out[2] and 0.5 * len(passage) < len(docs[1][1]) - len(out[2]) <= len(passage) + 24


def test_how_long_passages_are():
    units = lambda t: int(subdedup.UNITS[np.frombuffer(t.encode(), np.uint8)].sum())
    assert [units(t) for t in ("word ", "字かナ", "한국", "กข", "éß", "😀", "")] == [5, 9, 4, 2, 2, 3, 0]


# --- packing


def brute_first_fit(lengths, room):
    bins, out = [], []
    for n in lengths:
        for i, held in enumerate(bins):
            if held + n <= room:
                out.append((i, held))
                bins[i] += n
                break
        else:
            out.append((len(bins), 0))
            bins.append(n)
    return out


@given(st.lists(st.integers(1, 50), min_size=1, max_size=120))
@settings(max_examples=200, deadline=None)
def test_tournament(lengths):
    lengths.sort(reverse=True)
    assert list(zip(*packing.first_fit_decreasing(lengths, 50))) == brute_first_fit(lengths, 50)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))


TEXTS = st.text(alphabet=st.sampled_from("abcs 'tREve.,12éÉßſİΣ漢\n\x1c\x85　<|>-́"), max_size=60) | st.text(max_size=40) | st.sampled_from(["x<|endoftext|>y z", "it's 'S we'Ve <|startoftext|>", "ÀB'll c12d"])


def test_gzip_members_in_a_row():
    import gzip
    import random

    parts = [random.Random(i).randbytes(i * 37) for i in range(0, 4000, 200)]
    whole = b"".join(gzip.compress(x) + b"\0" * (i % 3) for i, x in enumerate(parts))
    assert warc.unzipped(whole) == b"".join(parts)
    broken = gzip.compress(b"first") + gzip.compress(parts[-1])[:-4000]
    assert warc.unzipped(broken).startswith(b"first" + parts[-1][:60000])
    assert warc.unzipped(gzip.compress(b"first") + b"junk") == b"first"


def test_long_texts_in_spans(library, monkeypatch):
    monkeypatch.setattr(packing.WordTokenizer, "SPAN", 40)
    monkeypatch.setattr(packing.WordTokenizer, "SPANS", re.compile(r"[\s\S]{1,40}\S*"))
    own = packing.WordTokenizer(packing.VOCABULARY)
    for text in ("it's a cat. " * 50, "x" * 300, "漢字 don't\u3000ÀB'll\n" * 20, "a\x1cb " * 30, "x<|endoftext|>y " * 9):
        assert np.frombuffer(own.encode([text, "", "é"])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert all(len(p) <= own.SHORT for p in own.known)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_word_tokenizer_equals_library(library, text):
    own = packing.tokenizer(packing.VOCABULARY)
    assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_full_caches(library):
    own = packing.WordTokenizer(packing.VOCABULARY, pieces=2)
    for text in ("a b c", "the cat's 9 lives, é", "d a the zebra. cat's", "d a the zebra. cat's"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("room, group", [(2048, 1 << 14), (16, 8)])
def test_pack(library, clashing, none, documents, room, group):
    for docs, texts in ((clashing, [(d, t) for d, t, _, _ in ROWS]), (documents, [(r["doc_id"], r["text"]) for r in documents.collect()])):
        got = rows(packing.pack(docs, room=room, group=group))
        want = []
        for d, t in texts:
            ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
            want += [(str(d), i, min(room, len(ids) - i), zlib.crc32(ids[i : i + room].tobytes()), len(ids)) for i in range(0, len(ids), room)]
        assert sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == sorted(want)
        held = {}
        for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
            assert r["offset"] == held.get(r["sequence_id"], 0)
            held[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(held.values()) <= room
    assert sum(held.values()) > 0.9 * room * (len(held) - 1)
    assert packing.pack(none).count() == 0


def test_documents_are_packed_whole_in_one_group(spark):
    """All pieces of a document share a group; rows that are alike in all do not."""
    docs = spark.createDataFrame([(1, "a b c d e f g h " * 40)] + [(None, "the same row " * 9)] * 300, "doc_id long, text string")
    got = packing.pack(docs, room=64, group=32).toPandas()
    groups = -(-len(got) // 32)
    assert got[got.doc_id == 1].sequence_id.mod(groups).nunique() == 1 and len(got[got.doc_id == 1]) > 3
    assert got[got.doc_id.isna()].sequence_id.mod(groups).nunique() > groups // 2


# --- sharding


@pytest.mark.parametrize("bucket_rows", [2_000, 7])
def test_shards(clashing, none, documents, bucket_rows):
    got = rows(sharding.interleave(clashing, shards=3, bucket_rows=bucket_rows))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _, _ in ROWS)
    out = sharding.interleave(documents, bucket_rows=bucket_rows).join(documents.select("doc_id", "source"), "doc_id").toPandas()
    assert len(out) == documents.count() and set(out.law) == {"rows"} and out.grown_shard.isna().all()
    count = out.groupby("shard").size()
    assert sorted(count.index) == list(range(24)) and count.max() - count.min() <= 1
    for _, slots in out.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    for source, n in out.groupby("source").size().items():
        each = out[out.source == source].groupby("shard").size().reindex(range(24), fill_value=0)
        assert each.max() <= n / 24 + 2 and each.min() >= n / 24 - 2
    again = sharding.interleave(documents.repartition(5), bucket_rows=bucket_rows).toPandas()
    assert set(zip(again.doc_id, again.shard, again.slot)) == set(zip(out.doc_id, out.shard, out.slot))
    assert sharding.interleave(none).count() == 0


def test_shards_against_brute_force(documents):
    """The same law by hand: ranks by a seeded hash within each source, all rows in the order of
    (rank - step) / count, and equal runs of them."""
    import xxhash as x

    def spark_hash(*parts):  # of integers, by Spark's rule: each one's hash seeds the next
        h = 42
        for kind, value in parts:
            data = value.to_bytes(4, "little", signed=True) if kind == "int" else value.to_bytes(8, "little", signed=True) if kind == "long" else value.encode()
            h = x.xxh64_intdigest(data, h)
        return h - 2**64 if h >= 2**63 else h

    rows_ = []
    for r in documents.select("doc_id", "text", "source").collect():
        data = (r["text"] or "").encode()
        size, crc = len(data) + 8, zlib.crc32(data)
        rows_.append(["+" + r["source"] if r["source"] is not None else "-", spark_hash(("int", 17), ("long", r["doc_id"]), ("long", crc), ("long", size)), r["doc_id"], crc, size])
    total, places = len(rows_), []
    buckets = -(-total // 2000)
    for stratum in {r[0] for r in rows_}:
        own = sorted((r for r in rows_ if r[0] == stratum), key=lambda r: (r[1] % buckets, *r[1:]))
        step = spark_hash(("int", 18), ("text", stratum)) % (1 << 20) / (1 << 20)
        places += [((k + 1 - step) / len(own), *r) for k, r in enumerate(own)]
    places.sort()
    want, seen = {}, Counter()
    for i, (_, _, _, doc, crc, size) in enumerate(places):
        shard = i * 24 // total
        want[doc] = (size, crc, shard, seen[shard])
        seen[shard] += 1
    got = {r["doc_id"]: (r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.interleave(documents).collect()}
    assert got == want


def test_starts_in_two_steps(spark):
    counts = spark.createDataFrame([("a", i, i % 7 + 1) for i in range(3000)] + [("b", 5, 2)], "s string, k long, n long")
    got = {(r["s"], r["k"]): r["start"] for r in sharding._starts(counts, ["s"], "k", step=64).collect()}
    at = 0
    for i in range(3000):
        assert got["a", i] == at
        at += i % 7 + 1
    assert got["b", 5] == 0


# --- neighbour search


def test_search_against_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet")
    out = ann.search(table, lambda i: i % 50 == 0, query_block=16, code_block=300).toPandas()
    data = table.toPandas()
    vectors, ids = ann.unit(np.array(data.embedding.tolist())), data.vec_id.to_numpy()
    hit = 0
    for i in np.flatnonzero(ids % 50 == 0):
        cosine = vectors @ vectors[i]
        cosine[i] = -2
        best = np.lexsort((ids, -cosine))[:5]
        own = out[out.query_id == ids[i]].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5]
        assert np.allclose(own.score, cosine[[np.flatnonzero(ids == v)[0] for v in own.vec_id]], atol=1e-12)
        assert (np.diff(own.score) <= 0).all()
        hit += len(set(own.vec_id) & set(ids[best]))
    assert hit >= 0.9 * len(out)


def test_search_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 0.0, 0.0], i) for i in range(0, 40)]
    odd = [(100, None, 0), (150, [0.0, 0.0, 0.0], 0), (200, [nan, 1.0, 0.0], 0), (250, [inf, 1.0, 0.0], 0), (300, [1.0, None, 0.0], 0), (350, [1.0, 2.0], 0), (400, [], 0), (None, [0.0, 1.0, 0.0], 0), (450, [0.0, 1.0, -0.0], 0), (451, [0.0, 1.0, 0.0], 0), (451, [0.0, 1.0, 0.0], 0), (500, [3e38, 0.0, 3e38], 0)]
    table = spark.createDataFrame(same + odd, "vec_id long, embedding array<float>, label int").selectExpr("*", "label AS key", "label AS ids", "label AS vec", "label AS block")
    got = rows(ann.search(table, lambda i: i % 50 == 0))
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    assert set(by) == {0, 450, 500}
    assert by[0] == [(i, 1.0) for i in range(1, 6)]
    assert by[450] == [(451, 1.0)] + [(i, 0.0) for i in (0, 1, 2, 3)]
    assert by[500] == [(i, round(0.5**0.5, 9)) for i in range(5)]
    few = rows(ann.search(table.where("vec_id in (0, 1, 450)"), lambda i: i % 50 == 0))
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in few) == [(0, 1, 1), (0, 2, 450), (450, 1, 0), (450, 2, 1)]
    assert ann.search(table.where("false"), lambda i: i % 50 == 0).count() == 0
    assert ann.search(table.where("vec_id = 1"), lambda i: i % 50 == 0).count() == 0


# --- WARC

PAGES = [
    (1, "http://a.example/x", '<html lang="fr"><head><title>A &amp; B</title><style>p{}</style></head><body><p>one<br>two &lt;3</p><script>var x="<p>no</p>"</script><a href=/z>z</a><!-- no --></body></html>'),
    (2, None, "plain"),
    (3, "http://b.example/", None),
    (3, "http://b.example/", None),
    (None, "http://c.example/\r\nX: y", "<p>unclosed <b>text <script>never ends"),
    (4, "", "<div>" * 3000 + "deep"),
]


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS record", "2 AS record_id")
    sources = rows(warc.from_pages(pages))
    got = rows(warc.derivatives(warc.from_pages(pages)))
    assert len(sources) == len(PAGES) and len(got) == 2 * len(PAGES)
    responses = {}
    for s in sources:
        (headers, block), = warc.read(bytes(s["record"]))
        assert warc.digest(block) == headers["WARC-Block-Digest"] and warc.digest(warc.payload(block)) == headers["WARC-Payload-Digest"]
        responses[headers["WARC-Record-ID"]] = headers
    assert len(responses) == len(PAGES) - 1  # equal pages, equal identifiers
    for r in got:
        (headers, block), = warc.read(bytes(r["record"]))
        source = responses[r["refers_to"]]
        assert headers["WARC-Refers-To"] == r["refers_to"] and headers["WARC-Type"] == r["record_type"]
        assert int(headers["Content-Length"]) == len(block) == r["content_length"]
        assert headers["WARC-Block-Digest"] == r["block_digest"] == warc.digest(block)
        assert headers["WARC-Target-URI"] == source["WARC-Target-URI"] and headers["WARC-Date"] == source["WARC-Date"]
        assert r["source_digest"] == source["WARC-Payload-Digest"] == headers["WARC-Source-Payload-Digest"]
        if r["record_type"] == "conversion":
            assert headers["WARC-Payload-Digest"] == warc.digest(block)
    text = {r["page_id"]: warc.read(bytes(r["record"])).__next__()[1].decode() for r in got if r["record_type"] == "conversion"}
    assert text[1] == "one\ntwo <3\nz" and text[2] == "plain" and text[3] == "" and text[None] == "unclosed text" and text[4] == "deep"
    about = {r["page_id"]: warc.read(bytes(r["record"])).__next__()[1].decode() for r in got if r["record_type"] == "metadata"}
    assert "title: A & B\r\n" in about[1] and "language: fr\r\n" in about[1] and "outlink: /z\r\n" in about[1]
    assert warc.derivatives(warc.from_pages(pages.where("false"))).count() == 0


def independent_records(data):
    """A reader of the test's own: header lines up to an empty one, and a block of the length given."""
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.split(b"\r\n")
        assert version == b"WARC/1.1"
        headers = dict(x.decode().split(": ", 1) for x in lines)
        n = int(headers["Content-Length"])
        out.append((headers, rest[:n]))
        assert rest[n : n + 4] == b"\r\n\r\n"
        data = rest[n + 4 :]
    return out


def sha1(data):
    import base64
    import hashlib

    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


PAGE = "<html><head><title>Prix</title></head><body><p>café à 3 €</p><p>fin</p></body></html>"


def chunked(data, size=7):
    return b"".join(b"%x;x=y\r\n%s\r\n" % (len(data[i : i + size]), data[i : i + size]) for i in range(0, len(data), size)) + b"0\r\n\r\n"


def http_cases():
    import gzip

    latin, utf = PAGE.replace("€", "EUR").encode("latin-1"), PAGE.encode()
    meta = PAGE.replace("<title>", '<meta http-equiv="content-type" content="text/html; charset=windows-1252"><title>').encode("cp1252")
    deflated = zlib.compress(utf)
    return [
        (b"Transfer-Encoding: chunked\r\nContent-Type: text/html; charset=ISO-8859-1", chunked(latin), "café à 3 EUR\nfin", latin),
        (b"content-encoding: gzip", gzip.compress(utf), "café à 3 €\nfin", gzip.compress(utf)),
        (b"Transfer-Encoding: Chunked\r\nContent-Encoding: GZip", chunked(gzip.compress(utf, mtime=0), 50), "café à 3 €\nfin", gzip.compress(utf, mtime=0)),
        (b"Content-Encoding: deflate", deflated, "café à 3 €\nfin", deflated),
        (b"Content-Encoding: deflate", deflated[2:-4], "café à 3 €\nfin", deflated[2:-4]),
        (b"Content-Type: text/html", meta, "café à 3 €\nfin", meta),
        (b"X-No: charset", PAGE.encode("cp1252"), "café à 3 €\nfin", PAGE.encode("cp1252")),
        (b"Content-Type: text/html", b"\xff\xfe" + PAGE.encode("utf-16-le"), "café à 3 €\nfin", b"\xff\xfe" + PAGE.encode("utf-16-le")),
        (b"Content-Type: text/html; charset=no-such", utf, "café à 3 €\nfin", utf),
        (b"Content-Encoding: br", b"\x0b\x02", "", b"\x0b\x02"),
        (b"Content-Encoding: gzip", gzip.compress(utf)[:-12], None, gzip.compress(utf)[:-12]),
        (b"Transfer-Encoding: chunked", b"not chunked <p>at all", "not chunked\nat all", b"not chunked <p>at all"),
    ]


def test_real_responses(spark):
    """Encodings, charsets, header names in any case, several records in a row, gzip members, and
    broken records; derivatives are read by the test's own reader."""
    import gzip

    cases, whole = http_cases(), []
    for i, (fields, body, _, _) in enumerate(cases):
        block = b"HTTP/1.1 200 OK\r\n" + fields + b"\r\n\r\n" + body
        whole.append(b"WARC/1.0\r\nwarc-type: response\r\nWARC-RECORD-ID: <urn:x:%d>\r\nwarc-target-uri: http://e.example/%d\r\nwarc-date: 2024-05-01T00:00:00Z\r\ncontent-length: %d\r\n\r\n%s\r\n\r\n" % (i, i, len(block), block))
    other = b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:x:r>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows_ = [(1, b"".join(whole[:6]) + other), (2, b"".join(gzip.compress(x) for x in whole[6:])), (3, b"no record at all"), (4, whole[0].replace(b"content-length", b"x")), (5, None), (6, whole[0] + b"junk"), (7, gzip.compress(whole[0])[:-20]), (8, whole[0].replace(b"WARC-RECORD-ID", b"WARC-Other"))]
    got = rows(warc.derivatives(spark.createDataFrame(rows_, "page_id long, record binary")))
    assert Counter(r["page_id"] for r in got) - Counter({7: 2}) == Counter({1: 12, 2: 12, 6: 2})
    texts, about = {}, {}
    for r in got:
        ((headers, block),) = independent_records(bytes(r["record"]))
        assert headers["WARC-Block-Digest"] == sha1(block) and headers["WARC-Refers-To"] == r["refers_to"]
        if r["page_id"] in (1, 2):
            i = int(r["refers_to"][7:-1])
            assert headers["WARC-Target-URI"] == f"http://e.example/{i}" and headers["WARC-Date"] == "2024-05-01T00:00:00Z"
            assert headers["WARC-Source-Payload-Digest"] == sha1(cases[i][3])
            (texts if r["record_type"] == "conversion" else about)[i] = block.decode()
            assert headers.get("WARC-Payload-Digest") == (sha1(block) if r["record_type"] == "conversion" else None)
    for i, (_, _, text, _) in enumerate(cases):
        assert text is None or texts[i] == text
    assert texts[10].startswith("café") and "undecoded: br" in about[9] and "title: Prix" in about[0]


def brute_text(page):
    """Visible text by the standard library's parser."""
    from html.parser import HTMLParser

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, _):
            self.skip += tag in ("script", "style", "head", "noscript", "template")
            if tag in warc._BLOCK:
                self.out.append("\n")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "head", "noscript", "template")
            if tag in warc._BLOCK:
                self.out.append("\n")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    parser = Parser()
    parser.feed(page)
    parser.close()
    return [" ".join(x.split()) for x in "".join(parser.out).splitlines() if x.strip()]


def test_whole_pages_against_a_parser(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = rows(warc.derivatives(warc.from_pages(pages)))
    assert len(got) == 2 * len(html)
    for r in got:
        if r["record_type"] == "conversion":
            ((_, block),) = independent_records(bytes(r["record"]))
            assert [" ".join(x.split()) for x in block.decode().splitlines() if x.strip()] == brute_text(html[r["page_id"]])


def test_unclosed_title_and_head():
    assert warc.visible("<head><title>T<p>one</p>two")[0] == "one\ntwo"
    assert warc.visible("<head><meta charset=x><div>a")[0] == "a"
    assert warc.visible("<head><title>T</title><link href=x></head>b")[0] == "b"


def test_warc_files(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_files(warc.derivatives(warc.from_pages(pages)), str(tmp_path / "w"), 2)
    found = spark.read.parquet(str(tmp_path / "w")).toPandas()
    whole = b"".join(map(bytes, found.sort_values("record_id").member))
    assert len(list(warc.read(whole))) == 2 * len(PAGES) and gzip.decompress(whole).startswith(warc.VERSION)


# --- pipeline


def test_pipeline(spark, sf_dir, clashing, none, documents):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        for docs in (none, clashing):
            out = stage(spark, docs, sf_dir)
            assert name == "packing" or out.columns == docs.columns
            out.collect()
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(got.doc_id) <= {r["doc_id"] for r in documents.collect()} and len(got)
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    kept = corpus_pipeline.near_dedup(spark, documents, sf_dir).select("doc_id", "text").toPandas()
    assert set(kept.doc_id) == set(got.doc_id) and not kept.text.duplicated().any()


def test_all_are_registered():
    import __spark_entry__ as entry

    names = [n.split("_")[0] for n in entry.queries()]
    assert [f"op{i}" for i in range(1, 11)] == [n for n in names if n.startswith("op")] and "pipeline" in names


def test_texts_in_no_learned_language_go(spark, sf_dir, documents):
    import corpus_pipeline

    draw = np.random.default_rng(3)
    letters = lambda alphabet, n: "".join(draw.choice(list(alphabet + "    "), n))
    foreign = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
        "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神互相对待",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem",
        "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق",
        *[letters("abcdefghijklmnopqrstuvwxyz", n) for n in (60, 300, 3000)],
        *[letters("абвгдежзийклмнопрстуфхцчшщъыьэюя", n) for n in (60, 300, 3000)],
    ]
    more = spark.createDataFrame([(10**9 + i, t, None, "x", len(t)) for i, t in enumerate(foreign)], documents.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, documents.unionByName(more), sf_dir).collect()}
    assert kept == {r["doc_id"] for r in documents.collect()}
