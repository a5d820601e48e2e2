"""Every operator of the subpackage against a brute-force version, a library or held-out labels, and on odd tables."""

import collections
import hashlib
import html.parser
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from triplane.llm import bpe, chat, exact_dedup, fingerprint, html_text, near_dedup, packing, quality, suffix_dedup, toxicity

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, name string, h long"


def _texts():
    r = random.Random(4)
    base = [" ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n)) for n in (3, 60, 150, 400)]
    near = [t.replace(" alpha", " omega", 1) for t in base]
    return [*base, *near, base[2], base[2], "", None, " \n\t", "É ü " * 90, "a" * 700, base[1] + " tail " + base[3][:500], "😀" * 120 + base[3][900:1400]]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 1) for i, t in enumerate(_texts())], DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _plain(odd):
    return {r.doc_id: r.text or "" for r in odd.collect()}


@pytest.mark.parametrize("block", [4096, 16])
def test_exact_duplicates(odd, block):
    got, texts = exact_dedup.exact_duplicates(odd, block).collect(), _plain(odd)
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    assert len(got) == len(texts)
    for r in got:
        g = groups[texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), r.doc_id == max(g), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_exact_duplicates_of_repeated_and_null_rows(spark, odd):
    twice = odd.unionByName(odd)
    assert exact_dedup.exact_duplicates(twice).count() == odd.count()
    assert exact_dedup.drop_exact_duplicates(twice).columns == odd.columns
    assert exact_dedup.drop_exact_duplicates(twice).count() == len({t or "" for t in _texts()})
    null = spark.createDataFrame([(None, "a"), (None, "b"), (1, None)], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(null).filter("kept").count() == 3


def _shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _family(r, base, rates):
    return [" ".join(w if r.random() > rate else f"x{r.random()}" for w in base.split()) for rate in rates]


def _same_as_all_pairs(docs):
    sets = {x.doc_id: _shingles(x.text or "") for x in docs.collect()}
    root = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = min(root[i], root[j])
    got = {x.doc_id: x for x in near_dedup.near_duplicates(docs).collect()}
    assert {i: x.component_id for i, x in got.items()} == root
    assert {i: x.n_shingles for i, x in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(x.kept == (x.doc_id == x.component_id) for x in got.values())


def _numbered(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, h long")


def test_near_duplicates(spark, odd):
    family = _family(random.Random(8), " ".join(f"w{k}" for k in range(300)), [0, *[0.02] * 12, *[0.035] * 12])
    _same_as_all_pairs(odd.select("doc_id", "text", "h").unionByName(_numbered(spark, family, 100)))


def test_near_duplicates_that_share_what_their_hub_lacks(spark):
    """Copies under the threshold with their base, and pairs of them that are near each other through edits of their own."""
    r, base = random.Random(9), " ".join(f"w{k}" for k in range(300))
    apart = _family(r, base, [0.045] * 10)
    twins = [t for far in _family(r, base, [0.045] * 5) for t in _family(r, far, [0.015] * 2)]
    _same_as_all_pairs(_numbered(spark, [*apart, *twins, base]))


@pytest.mark.parametrize("rate", [0.06, 0.035])
def test_near_duplicates_of_a_family_without_its_base(spark, rate):
    r = random.Random(12)
    _same_as_all_pairs(_numbered(spark, _family(r, " ".join(f"w{k}" for k in range(250)), [rate] * 45)))


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one doc_id are linked, and each of its texts with its own near copies."""
    one, two = (" ".join(f"{c}{k}" for k in range(80)) for c in "ab")
    rows = [(1, one), (1, two), (2, one + " x"), (3, two + " y"), (4, "other words"), (5, "other words"), (None, one), (1, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]


def test_word_hashes_of_long_texts(monkeypatch):
    r = random.Random(3)
    text = "".join(r.choice(["ab", "C", " ", "\n", "é", "0123456789" * 9]) for _ in range(3000)).encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", text.lower()) if w]
    whole = near_dedup.word_hashes(text)
    assert len(set(zip(words, whole.tolist()))) == len(set(words)) == len(set(whole.tolist()))
    short = near_dedup.word_hashes(b" ".join(w for w in words if len(w) < 64))
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    cut_up = near_dedup.word_hashes(text)
    assert len(cut_up) == len(words) and len(set(cut_up.tolist())) == len(set(words))
    assert near_dedup.word_hashes(b" ".join(w for w in words if len(w) < 64)).tolist() == short.tolist()


def _repeats(texts):
    count = collections.Counter(b[k : k + 200] for b in texts.values() for k in range(len(b) - 199))
    for i, b in texts.items():
        covered = bytearray(len(b))
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                covered[k : k + 200] = b"\1" * 200
        runs = sum(1 for k in range(len(b)) if covered[k] and (k == 0 or not covered[k - 1]))
        yield i, (len(b), sum(covered), runs, hashlib.sha256(bytes(x for x, m in zip(b, covered) if not m)).hexdigest())


@pytest.mark.parametrize("kinds", [2500, 2])
def test_repeats(odd, monkeypatch, kinds):
    monkeypatch.setattr(suffix_dedup, "KINDS", kinds)
    want = dict(_repeats({i: t.encode() for i, t in _plain(odd).items()}))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(odd).collect()}
    assert got == want


def test_repeats_keep_rows(spark, odd):
    out = suffix_dedup.drop_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    null = spark.createDataFrame([(None, "ab" * 150), (1, "ab" * 150), (1, None)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.without_repeats(null).collect()) == [0, 300, 300]


def _passages():
    """Long shared passages, whole, edited, shifted and within one text; a short phrase in common; texts of one sign."""
    r = random.Random(21)
    new = lambda n: "".join(r.choice("abcdefgh éü") for _ in range(n))
    p, q, phrase = new(3000), new(700), new(60)
    edited = p[:900] + "X" + p[901:1800] + "inserted" + p[1800:2500] + p[2540:]
    texts = [new(300) + p + new(100), p, new(50) + edited + new(250), p[:1500], q + new(20) + q + new(199) + q[3:], new(90) + q[100:500] + p[2000:2600], "z" * 650, "z" * 199, "yz" * 170 + q[:250]]
    return [*texts, *(new(400) + phrase + new(400) for _ in range(5)), texts[2], "", None]


@pytest.mark.parametrize("stretch", [1 << 13, 64])
def test_repeats_in_stretches(spark, monkeypatch, stretch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    docs = _numbered(spark, _passages())
    want = dict(_repeats({i: t.encode() for i, t in _plain(docs).items()}))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(docs).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 15_000


def _sent(docs):
    rows = suffix_dedup._keyed(docs)
    members = suffix_dedup._anchor_rows(rows)
    often = members.groupBy("h").count().filter("count > 1").select("h")
    return suffix_dedup._wanted(suffix_dedup._kinds(members.join(often, "h"))).agg(F.sum("n")).first()[0] or 0


def test_repeats_send_each_byte_about_once(spark):
    """A passage in two texts goes as two stretches (overlapping segments would be over three times as long), a short phrase not at all."""
    r = random.Random(22)
    new = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    p, phrase = new(6000), new(60)
    assert 11_500 < _sent(_numbered(spark, [new(300) + p + new(300), p, new(400)])) < 14_000
    assert _sent(_numbered(spark, [new(400) + phrase + new(400) for _ in range(9)])) == 0


def test_anchors_of_texts_hashed_together():
    r = random.Random(23)
    parts = [bytes(r.choice(b"ab" if k % 3 else b"abcdefgh") for _ in range(r.choice([200, 201, 340, 900]))) for k in range(30)]
    parts += [b"a" * 500, parts[0] + parts[1]]
    whole = list(zip(*(x.tolist() for x in suffix_dedup.anchors(parts)), strict=True))
    alone = [(h, k, *more) for k, p in enumerate(parts) for h, _, *more in zip(*(x.tolist() for x in suffix_dedup.anchors([p])), strict=True)]
    assert whole == alone and [x[0] for x in whole] == suffix_dedup.anchors(parts, named=False)[0].tolist()
    for k, p in enumerate(parts):
        held = [s for _, part, _, first, last, *_ in whole if part == k for s in range(first, last + 1)]
        assert held == list(range(len(p) - 199))


@pytest.mark.parametrize("seed", range(20))
def test_interval_expansion(seed):
    r = random.Random(seed)
    parts = ["".join(r.choice("ab" if seed % 2 else "abcdef") for _ in range(r.randint(1, 50))).encode() for _ in range(9)]
    count = collections.Counter(p[k : k + 7] for p in parts for k in range(len(p) - 6))
    assert [x.tolist() for x in suffix_dedup.repeated_starts(parts, 7)] == [[k for k in range(len(p) - 6) if count[p[k : k + 7]] > 1] for p in parts]


def test_packing(odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t, texts = Tokenizer.from_file(path), _plain(odd)
    rows = packing.pack_documents(odd, path, 256).collect()
    by, ids = collections.defaultdict(list), {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in texts.items()}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        ends = np.cumsum([0, *(n for _, n in sorted(places))])
        assert [o for o, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 256
    pieces = sorted((r.doc_id, r.piece, r.start, r.length) for r in rows)
    assert {i: sum(x[3] for x in pieces if x[0] == i) for i in ids} == {i: len(x) for i, x in ids.items()}
    assert all(n == 256 for _, k, _, n in pieces if k)
    assert len(by) <= len(_best_fit([n for *_, n in pieces], 256).bins)


def _best_fit(sizes, capacity):
    plain = packing.Bins(sizes, capacity)
    plain.add(sorted(range(len(sizes)), key=lambda i: -sizes[i]))
    return plain


def _hard_sizes(seed, n):
    """Sizes of which three each fill a bin of 1000, so that n bins are enough."""
    r = random.Random(seed)
    for _ in range(n):
        a = r.randint(380, 490)
        b = r.randint(250, (1000 - a) // 2)
        yield from (a, b, 1000 - a - b)


@pytest.mark.parametrize("seed", range(4))
def test_evolution_beats_plain_best_fit(seed):
    sizes = list(_hard_sizes(seed, 40))
    best = packing.evolve(sizes, 1000, seed, [])
    assert sorted(i for b in best.bins for i in b) == list(range(120)) and max(best.loads) <= 1000
    assert best.loads == [sum(sizes[i] for i in b) for b in best.bins]
    assert len(best.bins) < len(_best_fit(sizes, 1000).bins) - 2


def test_crossover_injects_whole_bins_and_keeps_every_item():
    sizes, rng = list(_hard_sizes(9, 60)), np.random.default_rng(1)
    a, b = _best_fit(sizes, 1000), packing.Bins(sizes, 1000, [[3 * k, 3 * k + 1, 3 * k + 2] for k in range(60)])
    before = [list(x) for x in a.bins]
    for _ in range(20):
        child = packing.crossover(a, b, rng)
        assert sorted(i for x in child.bins for i in x) == list(range(180)) and max(child.loads) <= 1000
        assert sum(x in b.bins for x in child.bins) > 0 and a.bins == before


def test_islands_pass_on_their_best(spark):
    sizes = list(_hard_sizes(5, 40))
    rows = spark.createDataFrame([(i, n, "u", i) for i, n in enumerate(sizes)], "doc_id long, length long, uid string, row int")
    out = packing.pack(rows, 1000)
    assert out.columns == [*rows.columns, "sequence_id", "offset"] and out.filter("uid = 'u' AND row = doc_id").count() == 120
    assert out.select("sequence_id").distinct().count() < len(_best_fit(sizes, 1000).bins) - 2
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1000").count() == 0


def test_bpe(odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, texts = Tokenizer.from_file(path), _plain(odd) | {}
    t.no_padding(), t.no_truncation()
    for r in bpe.encode_decode(odd, path).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    hard = ["a\x1cb !\x1f! \x1d", "x" * 5000, "ab" * 3000 + "!?", "".join(random.Random(2).choice("abcdefghij") for _ in range(6000)), "é" * 1500 + "12<|startoftext|>", "a<|endoftext|>B", "ΣΑΣ", "İ ẞ ǅ", "it's I'LL 12½", "x\u0085y z", "aaaaaaaaa", "中文 字"]
    assert [np.frombuffer(b, "<u4").tolist() for b, _ in bpe.load(path).encode_batch(hard)] == [t.encode(x, add_special_tokens=False).ids for x in hard]


def test_bpe_of_one_very_long_word():
    b, began = bpe.load(public_tokenizers.path("word_bpe_49k.json")), time.perf_counter()
    b.encode_batch(["".join(random.Random(5).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))])
    assert time.perf_counter() - began < 30


def _h64(*xs):
    """Spark's xxhash64, as a signed number."""
    seed = 42
    for v in xs:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def _windows(text):
    """(place, hash) of the closed syncmers of a text, in plain Python."""
    alone = "".join(rf"\p{{{s}}}" for s in "Han Hiragana Katakana Hangul Thai Lao Khmer Myanmar".split())
    pieces = regex.findall(rf"[{alone}]|[^\x20\x09-\x0D{alone}]{{1,4}}", text)
    h = [0, 1, 2, 3, *(_h64(p.encode()) for p in pieces), 0, 1] if pieces else []
    s = [_h64(a, b) for a, b in zip(h, h[1:])]
    return [(i, _h64(s[i], s[i + 2], h[i + 4]) & 0xFFFFFFFF) for i in range(len(h) - 4) if min(s[i : i + 4]) in (s[i], s[i + 3])]


def _sketch(text):
    return sorted({w for _, w in _windows(text)})[:64] or [_h64(text.encode()) & 0xFFFFFFFF]


def _likeness(a, b):
    union = sorted({*a, *b})[:64]
    return sum(w in a and w in b for w in union) / len(union)


@pytest.mark.parametrize("part_bytes", [1 << 20, 1000, 10])
def test_fingerprints(odd, monkeypatch, part_bytes):
    """Every column against plain Python, however the texts are dealt."""
    monkeypatch.setattr(fingerprint, "PART_BYTES", part_bytes)
    texts, got = _plain(odd), {r.doc_id: r for r in fingerprint.fingerprints(odd).collect()}
    order = sorted(texts)
    show = lambda sk: "".join(f"{w:08x}" for w in sk)
    for k, i in enumerate(order):
        after, n = texts[order[(k + 1) % len(order)]], len(texts[i])
        edited = texts[i][: n - n // 2] + after[: n // 2]
        own, new = _sketch(texts[i]), _sketch(edited)
        assert (got[i].n_chars, got[i].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (show(own), show(new))
        assert (got[i].near_edited, got[i].near_next) == (_likeness(own, new), _likeness(own, _sketch(after)))


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(2, "b c d e f g"), (2, "b c d e f g"), (2, "other words"), (None, "a b"), (None, None), (7, "x y z")]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 3), (2, 11), (2, 11), (2, 11), (7, 5)]
    alone = fingerprint.fingerprints(spark.createDataFrame([(1, "one text of some words")], "doc_id long, text string")).first()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"one text ofone text of").hexdigest()


def test_fingerprints_of_texts_without_spaces_and_of_short_ones(spark):
    zh = "".join(chr(0x4E00 + k * 7919 % 5000) for k in range(4000))
    rows = [(1, zh), (2, zh[:3990] + "\u4e00" * 10), (3, "the quick brown fox jumps over lazy dogs"), (4, "the quick brown fox jumps over lazy cats"), (5, "ab" * 3000), (6, "ab" * 2900)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].near_next > 0.9 and 0.3 < got[3].near_next < 1 and got[5].near_next > 0.5
    assert all(_windows("".join(random.Random(k).choice("abc d") for _ in range(k % 9)) + "e") for k in range(300))


def test_closed_syncmers_against_plain_python(spark):
    text = " ".join(random.Random(6).choice(WORDS) for _ in range(80))
    assert [(r.place, r.hash) for r in fingerprint.anchors(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == _windows(text)


def test_chat(spark):
    hard = ["</s>[INST] ok [/INST]", "&lt;s>", "<s>[!OUT]x</s>", "", None, "a & b [x] <y>", "line\nbreak </s", "[/INST"]
    rows = [(c, t, role, text) for c in range(3) for t, (role, text) in enumerate((r, x) for x in hard for r in ("user", "assistant", "system", "odd]role", None))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.chat_format(df).collect():
        mine = [(role or "", text or "") for c, _, role, text in rows if c == r.conv_id]
        loss = "".join(t for role, t in mine if role == "assistant")
        assert r.n_turns == len(mine) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_html(spark):
    page = """<html><head><title>no</title><script>if (a < b) {}</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy now</div>
      <article><h1>A title</h1><p>Caf&eacute;  <b>bold</b>\n text.<br>More.</p><p>Second paragraph of the text.</article><div class="comments"><p>Nice post</p></div><footer>&copy; me</footer></body></html>"""
    rows = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(rows).collect()}
    text = "A title\nCafé bold text. More.\nSecond paragraph of the text."
    assert got == {1: (text, len(text)), 2: ("", 0), 3: ("", 0)}


class _Article(html.parser.HTMLParser):
    """The text of <article>, by another parser than the operator's: a block ends at every tag that is not inline."""

    def __init__(self, page):
        super().__init__()
        self.depth, self.blocks, self.skip = 0, [""], 0
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style")
        self.blocks += [] if tag in html_text.INLINE - {"br"} else [""]

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style")
        self.blocks += [] if tag in html_text.INLINE else [""]

    def handle_data(self, data):
        if self.depth > 0 and not self.skip:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(" ".join(b.split()) for b in self.blocks if b.strip())


def test_pages_against_their_articles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: _Article(r.html).text() for r in rows.collect() if "<article" in r.html}
    got = {r.page_id: r.text for r in html_text.main_text(rows).collect()}
    assert len(want) > 100
    assert sum(got[i] != want[i] for i in want) <= 1


def test_html_keeps_formulae_and_words_around_comments():
    page = "<article><h1>On circles and their area</h1><p>The area is <math><mi>r</mi><msup><mn>2</mn></msup></math> units, Up<!-- c -->per bound.</p></article>"
    assert [b.text for b in html_text.blocks_of(page)] == ["On circles and their area", "The area is r2 units, Upper bound."]
    assert html_text.extract([page], html_text.trained())[0].endswith("The area is r2 units, Upper bound.")


def test_html_of_deep_and_long_pages():
    deep = "<div class='a'>x " * 20_000 + "</p>" * 20_000
    long = "<article>" + "".join(f"<p>Word {k} of a text, with more words.</p>" for k in range(20_000)) + "</article>"
    short = ["<nav><a href='/'>Home</a></nav><article><h1>A title</h1><p>Some text, of a page.</p></article>"] * 255
    model = html_text.trained()
    tracemalloc.start()
    began = time.perf_counter()
    got = html_text.extract([deep, long, *short], model)
    assert tracemalloc.get_traced_memory()[1] < 500e6 and time.perf_counter() - began < 120
    tracemalloc.stop()
    assert len(set(got[2:])) == 1 and got[1].count("\n") > 19_000
    blocks = html_text.blocks_of(long)[: html_text.PASS_BLOCKS + 50]
    _, p, _, _ = model._forward(*model.padded([html_text.vectors(blocks)]))
    assert np.allclose(model._long(blocks), p[:, 0], atol=1e-5)


@pytest.mark.parametrize("size", [10, 1999, 2000, 2001, 9000])
def test_capital_rate_is_of_letters_at_every_length(size):
    text = ("woRD mIxEd Éa ǅ Ⅻ 𝐀b " * size)[:size]
    got = dict(zip(toxicity.FEATURES, toxicity.features_of(text, toxicity.SEEDS), strict=True))
    assert got["capital_rate"] == sum(map(str.isupper, text)) / size


def test_calibration_keeps_the_top_of_its_curve(spark, monkeypatch):
    class Curve:
        boundaries = predictions = [k / 1000 for k in range(1001)]
        __init__, fit = (lambda self, **_: None), (lambda self, _: self)

    monkeypatch.setattr(toxicity, "IsotonicRegression", Curve)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    assert model.steps[-1] == (1.0, 1.0) and model.score(docs).agg(F.max("score")).first()[0] > 0.5


def _plain_features(text, lexicon):
    """The toxicity features by their definitions, without regard to cost."""
    raw, lower, n = text.split(), text.lower().split(), len(text.split())
    if not n:
        return [0.0] * len(toxicity.FEATURES)
    bare = [w if w.isalpha() else w.strip(toxicity.STRIP) for w in lower]
    told = ["hit" if b in lexicon else "you" if b in toxicity.SECOND_PERSON else "mixed" if b and not b.isalpha() else "" for b in bare]
    plain = [w.translate(toxicity.LEET).strip(toxicity.STRIP) for w in lower]
    hidden = [k for k in range(n) if told[k] == "mixed" and plain[k] != bare[k] and plain[k] in lexicon]
    hits, seconds = sorted([k for k in range(n) if told[k] == "hit"] + hidden), [k for k in range(n) if told[k] == "you"]
    rate = lambda signs, f=1: f * sum(text.count(s) for s in signs) / len(text)
    return [
        100 * len(hits) / n, np.log1p(len(hits)), len({bare[k] for k in hits if told[k] == "hit"}), 100 * sum(bare[k] in toxicity.SEEDS for k in hits if told[k] == "hit") / n,
        max([sum(0 <= j - i <= 30 for j in hits) for i in hits], default=0), 100 * len(seconds) / n, sum(np.exp(-min([abs(i - j) for j in seconds], default=99) / 4) for i in hits),
        sum(c.isupper() for c in text) / len(text), sum(w.isupper() for w in raw) / n, rate("!", 100), rate("?", 100), rate("*#%&$|@^~", 100), rate("0123456789"),
        100 * len(hidden) / n, told.count("mixed") / n, 1 - len(set(raw)) / n, np.log1p(n),
    ]


def _walk(lines, row):
    """What a printed tree predicts for a row."""
    at, depth = 0, -1
    while True:
        line = lines[at]
        if m := re.match(r" *Predict: (\S+)", line):
            return float(m[1])
        here, feature, limit = re.match(r"( *)If \(feature (\d+) <= (\S+)\)", line).groups()
        assert len(here) > depth
        depth = len(here)
        if row[int(feature)] <= float(limit):
            at += 1
        else:
            at = next(k for k in range(at, len(lines)) if lines[k].startswith(f"{here}Else (")) + 1


def test_toxicity_against_plain_features_trees_and_curve(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = [(10**9 + k, s) for k, s in enumerate(["", None, "YOU are an 1d10t! @ss you idiot", "?! you", "ſ ǅ É idiot idiot you", "*** #1 id*iot"])]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    model = toxicity.fit(docs, labels)
    trees = [part.split("\n")[1:] for part in re.split(r"\n *Tree \d+ \(weight [^\n]*\):?", model.trees.toDebugString)[1:]]
    trees, weights = [[line for line in t if line.strip()] for t in trees], model.trees.treeWeights
    assert len(trees) == len(weights) == 20
    for r in model.score(docs).select("doc_id", "text", "score", "predicted").collect():
        row = _plain_features(r.text or "", model.lexicon)
        assert toxicity.features_of(r.text or "", model.lexicon) == pytest.approx(row)
        p = 1 / (1 + np.exp(-2 * sum(w * _walk(t, row) for w, t in zip(weights, trees, strict=True))))
        below = max([k for k in model.steps if k[0] <= p], default=model.steps[0])
        above = min([k for k in model.steps if k[0] >= p], default=model.steps[-1])
        share = (p - below[0]) / (above[0] - below[0]) if above[0] > below[0] and below[0] <= p <= above[0] else 0
        want = 0.99 * (below[1] + share * (above[1] - below[1])) + 0.01 * p
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == int(r.score >= 0.5)


def test_curve_is_the_isotonic_fit(spark):
    """The curve that the calibration keeps is that of pooling adjacent violators, at every score it was fitted on."""
    r = random.Random(2)
    points = sorted((round(r.random(), 3), float(r.random() < 0.5)) for _ in range(400))
    by = collections.defaultdict(list)
    for s, y in points:
        by[s].append(y)
    pools = []
    for s in sorted(by):
        pools.append([sum(by[s]), len(by[s]), [s]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            y, n, xs = pools.pop()
            pools[-1] = [pools[-1][0] + y, pools[-1][1] + n, pools[-1][2] + xs]
    steps = toxicity.curve_of(spark.createDataFrame(points, "s double, toxic double"))
    got = np.interp([s for *_, xs in pools for s in xs], *zip(*steps, strict=True))
    assert got == pytest.approx([y / n for y, n, xs in pools for _ in xs])


def test_network_against_plain_loops():
    r = random.Random(7)
    model, texts = quality.ByteCnn.start(5), ["", "a", "short text", "é" * 200, " ".join(r.choice(WORDS) for _ in range(400))]
    model.bias = np.linspace(-0.2, 0.2, quality.FILTERS).astype(np.float32)
    for text, got in zip(texts, model.score(texts), strict=True):
        data, pooled, lo = text.encode(), [], 0
        while True:
            codes = [b + 1 for b in data[lo : lo + quality.CHUNK]]
            codes += [0] * (quality.CHUNK - len(codes))
            answers = [np.concatenate([model.embed[c] for c in codes[k : k + quality.WIDTH]]) @ model.filters + model.bias for k in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE)]
            pooled.append(np.maximum(np.max(answers, axis=0), 0))
            lo += quality.CHUNK - quality.OVERLAP
            if lo + quality.OVERLAP >= len(data):
                break
        both = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
        assert got == pytest.approx(1 / (1 + np.exp(-(both @ model.head + model.shift))), abs=1e-4)


@pytest.mark.parametrize("n", [40, 100_000])
def test_first_by_hash_is_bounded_and_whole(spark, n):
    from triplane.llm.common import first_by_hash

    rows = spark.range(n).withColumnRenamed("id", "doc_id")
    got = [r.doc_id for r in first_by_hash(rows, 500).collect()]
    assert got == list({*got}) or len(set(got)) == len(got)
    assert len(got) == min(n, 500)
    if n > 500:
        keys = sorted((_h64(i) & (1 << 64) - 1) >> 1 for i in range(n))[:500]
        assert sorted((_h64(i) & (1 << 64) - 1) >> 1 for i in got) == keys


@pytest.mark.parametrize(("operator", "label", "least"), [(toxicity.toxicity, "toxic", 0.95), (quality.quality, "quality", 0.9)])
def test_classifiers_on_held_out_labels(spark, operator, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = operator(docs, labels)
    assert rows.count() == docs.count() and rows.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    held = rows.filter("held_out").join(labels, "doc_id").select(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert held >= least


def test_classifiers_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, none).filter("score = 0").count() == odd.count()
    assert quality.quality(odd, none).filter("score = 0").count() == odd.count()
    assert toxicity.drop_toxic(odd, none).columns == odd.columns


def test_empty_tables(spark, empty):
    path = public_tokenizers.path
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        exact_dedup.exact_duplicates(empty), exact_dedup.drop_exact_duplicates(empty), near_dedup.near_duplicates(empty), near_dedup.drop_near_duplicates(empty), suffix_dedup.without_repeats(empty),
        suffix_dedup.drop_repeats(empty), packing.pack_documents(empty, path("byte_bpe_50k.json")), bpe.encode_decode(empty, path("word_bpe_49k.json")), fingerprint.fingerprints(empty),
        toxicity.toxicity(empty, none), quality.quality(empty, none), chat.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")),
        html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.count() == 0


def test_scratch_deletes_what_is_not_kept(spark):
    import os

    from triplane.llm.common import cut, scratch, shared_folder

    shared_folder(spark)
    with scratch(spark) as keep_outer:
        with scratch(spark) as keep:
            gone, kept = cut(spark.range(3)), cut(spark.range(4))
            keep(kept)
        paths = [df.inputFiles()[0].removeprefix("file:").replace("///", "/") for df in (gone, kept)]
        assert [os.path.exists(p) for p in paths] == [False, True] and kept.count() == 4
        keep_outer()
    assert not os.path.exists(paths[1])


LONG = " ".join(f"w{k}" for k in range(150_000))  # over a million signs
CLASH = "uid rep h d x n part sk own name bin island elite length sequence_id offset score predicted held_out kept component_id keep_id size far near a b c v t p row one".split()
PACK, BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PER_DOCUMENT = {
    "exact": exact_dedup.exact_duplicates, "near": near_dedup.near_duplicates, "repeats": suffix_dedup.without_repeats, "bpe": lambda d: bpe.encode_decode(d, BPE), "fingerprints": fingerprint.fingerprints,
    "packing": lambda d: packing.pack_documents(d, PACK).drop("sequence_id", "offset"),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_other_columns_and_repeated_rows(spark, odd, name):
    """Columns of clashing names change nothing; each row of a repeated document gets its row (exact: they count once)."""
    few = odd.select("doc_id", "text").filter("doc_id % 3 = 0")
    wide = few.withColumns({c: F.lit("q") for c in CLASH})
    rows = lambda df: sorted(map(repr, df.collect()))
    once, f = rows(PER_DOCUMENT[name](few)), PER_DOCUMENT[name]
    assert rows(f(wide)) == once
    twice = [r.doc_id for r in f(wide.unionByName(wide)).collect()]
    times = 1 if name == "exact" else 2
    assert sorted(twice) == sorted(times * [r.doc_id for r in f(few).collect()])


def test_very_long_texts(spark):
    docs, data = spark.createDataFrame([(1, LONG), (2, "w1 w2 w3 w4 w5 w6"), (3, None)], "doc_id long, text string"), LONG.encode()
    sha = hashlib.sha256(data).hexdigest()
    by = lambda df: {r.doc_id: r for r in df.collect()}
    assert by(exact_dedup.exact_duplicates(docs))[1].text_sha256 == sha
    assert {i: r.n_shingles for i, r in by(near_dedup.near_duplicates(docs)).items()} == {1: 149_996, 2: 2, 3: 0}
    got = by(suffix_dedup.without_repeats(docs))[1]
    assert (got.n_bytes, got.n_removed, got.kept_sha256) == (len(data), 0, sha)
    got = by(fingerprint.fingerprints(docs))[1]
    assert got.fingerprint == "".join(f"{w:08x}" for w in _sketch(LONG)) and got.n_chars == len(LONG)
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(BPE).encode(LONG, add_special_tokens=False).ids
    assert by(bpe.encode_decode(docs, BPE))[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    ids = [*Tokenizer.from_file(PACK).encode(LONG, add_special_tokens=False).ids, 2]
    pieces = [r for r in packing.pack_documents(docs, PACK).collect() if r.doc_id == 1]
    assert sum(r.length for r in pieces) == len(ids) and all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in pieces)
    model = quality.ByteCnn.start()
    whole = model.answers(quality.chunks_of(data))
    assert by(quality.score(docs, model, ["doc_id"]))[1].score == pytest.approx(float(model.probability(whole, np.array([0]))[0]), abs=1e-6)
    told = toxicity.ToxicityModel(toxicity.SEEDS, None, [], 0.25)
    assert by(told.score(docs))[1].score == 0.25 and toxicity.features_of(LONG, toxicity.SEEDS)[-1] == pytest.approx(np.log1p(150_000))
    turns = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", LONG + " [INST]")], "conv_id long, turn long, role string, text string")
    assert chat.chat_format(turns).first().loss_sha256 == hashlib.sha256((LONG + " [INST]").encode()).hexdigest()


def test_html_and_chat_with_other_columns_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Some text of a page.</p></article>", "q", 3, "z")] * 2, "page_id long, url string, html string, text string, n_chars int, path string")
    assert [tuple(r) for r in html_text.main_text(pages).collect()] == [(1, "u", "Some text of a page.", 20)] * 2
    turns = spark.createDataFrame([(1, 0, "user", "a", "q", "z")] * 2 + [(None, 0, None, None, None, None)], "conv_id long, turn long, role string, text string, rendered string, formatted string")
    assert sorted((r.conv_id or 0, r.n_turns, r.turns_sha256) for r in chat.chat_format(turns).collect()) == [
        (0, 1, hashlib.sha256(b"\n\n").hexdigest()), (1, 2, hashlib.sha256(b"user\na\nuser\na\n").hexdigest()),
    ]


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty):
    import corpus_pipeline

    for docs in (empty, odd.unionByName(odd)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            docs, n = out.cache(), out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count() == n


def test_pipeline(spark):
    """Each stage against brute force on its own input."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    score = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    before, docs = rows(docs), stages["toxicity"](spark, docs, SF).cache()
    assert rows(docs) == {i: r for i, r in before.items() if not score[i]} and 0 < docs.count() < len(before)
    before, docs = rows(docs), stages["exact"](spark, docs, SF).cache()
    keep = {r.text or "": i for i, r in sorted(before.items())}
    assert rows(docs) == {i: before[i] for i in keep.values()}
    before, docs = rows(docs), stages["near"](spark, docs, SF).cache()
    sets, root = {i: _shingles(r.text or "") for i, r in before.items()}, {i: i for i in before}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    for _ in links:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    assert rows(docs) == {i: r for i, r in before.items() if root[i] == i}
    before, docs = rows(docs), stages["passages"](spark, docs, SF).cache()
    want = dict(_repeats({i: (r.text or "").encode() for i, r in before.items()}))
    after = rows(docs)
    assert set(after) == set(before)
    for i, r in after.items():
        assert r.text == before[i].text if not want[i][1] else r.n_chars == len(r.text) and len((before[i].text or "").encode()) - want[i][1] >= len(r.text.encode())
    out = stages["packing"](spark, docs, SF).cache()
    assert {r.doc_id for r in out.collect()} == set(after)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
