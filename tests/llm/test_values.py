"""Pure functions of the corpus operators against slow, plain versions."""

from __future__ import annotations

import random
import re
import struct
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peakloom.llm import common, dedup, langid, media, packing, pages, pii, quality, rules, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\t\n\x0b\x1c", max_size=30))
def test_word_hashes(text):
    words = WORD.findall(text)
    h = common.word_hashes(text.encode())
    assert len(h) == len(words)
    known = {}
    for w, x in zip(words, h.tolist(), strict=True):
        assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


def test_word_hashes_of_long_text_in_blocks(monkeypatch):
    text = (" ".join(f"w{i}" for i in range(5000)) + "  " + "x" * 3000).encode()
    whole = common.word_hashes(text)
    monkeypatch.setattr(common, "_BLOCK", 1000)
    assert (common.word_hashes(text) == whole).all()


def _shingles(text):
    w = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("text", ["", " \n", "a", "a b c d", "a b c d e", "A b c d e a b c d e f", "x " * 50, "É a b c d e"])
def test_shingle_counts(text):
    assert len(common.shingle_hashes(text.encode())) == len(_shingles(text))


def test_shingle_case():
    one, two, other = (common.shingle_hashes(t.encode()).tolist() for t in ("Ab cd", "aB  cd", "abcd"))
    assert one == two != other


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.75, 0.9):
        errors = []
        for _ in range(20):
            x = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
            common_part = int(2000 * 2 * share / (1 + share))
            a, b = x[:2000], np.concatenate((x[:common_part], r.integers(0, 1 << 63, 2000 - common_part, dtype=np.uint64)))
            p, q = dedup.sketch(a), dedup.sketch(b)
            assert (dedup.merge(p, q) == dedup.sketch(np.concatenate((a, b)))).all()
            g, e = (p > q).sum(), (p == q).sum()
            j = dedup.likely_similarity(*(np.array([v], float) for v in (g, e, dedup.REGISTERS - g - e, 2000, 2000)))[0]
            errors.append(j - share)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_bands_find_pairs_at_the_limit():
    r, missed = np.random.default_rng(2), 0
    for _ in range(300):
        x = r.integers(0, 1 << 63, 700, dtype=np.uint64)
        a, b = x[:600], x[100:]  # 500 of 700
        missed += not set(dedup.bands(dedup.sketch(a)).tolist()) & set(dedup.bands(dedup.sketch(b)).tolist())
    assert missed == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _base_slowly(text):
    digits = lambda s: [int(c) for c in s if c in "0123456789"]
    luhn = lambda d: sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], pii.KINDS.index(x[2])))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="a1.@-+ 9(é", max_size=40), st.lists(st.sampled_from(["4845168114407329", "+1 (017) 555-7713", "97.51.17.173", "a.b@c.de", " ", "-", ".", "4", "999.1.1.1", "0001.2.3.4"]), max_size=8).map("".join)))
def test_base_spans(text):
    assert [s[:3] for s in pii.spans(text) if s[2] in pii.BASE] == _base_slowly(text)


def test_long_runs_take_linear_time():
    for c in "a1+@.-4 ":
        pii.spans(c * 300_000)
    pii.spans("1." * 150_000)
    pii.spans("a@" * 150_000)


def test_added_kinds_and_context():
    kinds = lambda t: [k for *_, k, _ in pii.spans(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 end") == ["iban"]
    assert "iban" not in kinds("IBAN GB82 WEST 1234 5698 7654 33 end")
    assert kinds("my ssn is 078-05-1120.") == ["national_id"] and kinds("number 078-05-1120.") == []
    assert kinds('token = "1d7f0a2b3c4d5e6f98"') == ["secret"] and kinds("token = aaaaaaaaaaaaaaaaaaaaaaa") == []
    assert pii.redacted("to a@b.co now") == "to <email> now" and pii.redacted(None) is None and pii.redacted("") == ""


def test_whole_secrets():
    for n in (16, 200, 201, 5000):
        secret = ("a1B2c3D4e5F6g7H8" * (n // 16 + 1))[:n]
        assert pii.redacted(f"token = '{secret}' end") == "token = '<secret>' end"


@pytest.mark.parametrize("code", ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"])
@pytest.mark.parametrize("after", ["", " BIC COBADEFFXXX", " 2024", " OR", " BANK AND MORE WORDS IN CAPITALS 12", ", then", " GB82 WEST 1234 5698 7654 32"])
def test_ibans_before_other_words(code, after):
    text = f"IBAN {code}{after}"
    got = [text[a:b] for a, b, k, _ in pii.spans(text) if k == "iban"]
    assert got == [code] + ["GB82 WEST 1234 5698 7654 32"] * ("GB82" in after)


def test_no_iban_within_a_longer_code():
    assert not [k for *_, k, _ in pii.spans("IBAN DE89370400440532013000A1") if k == "iban"]
    assert not [k for *_, k, _ in pii.spans("IBAN DE89 3704 0044 0532 0130 01 BIC") if k == "iban"]


def test_many_iban_candidates_take_linear_time():
    pii.spans("DE89 3704 0044 0532 0130 01 BIC " * 3_000)
    pii.spans("AB12" * 50_000)
    pii.spans("AB12 " * 30_000)


@pytest.fixture(scope="module")
def counter():
    return tokens.PrefixCounter(tokens.default_tokenizer())


ODD = ["it's  don't   've\n\n x", "a<|endoftext|>  b  <|endoftext|>", "日本語 text", "x" * 3000, "  ", "\n \n  ab", "!!'re$$ 12 345", "Ünï  'll", "", "a\x1cb", "<|endoftext|", "'", " 's"]


@pytest.mark.parametrize("text", ODD)
def test_counts_of_every_prefix(counter, text):
    encode = lambda t: len(counter.library.encode(t, add_special_tokens=False).ids)
    table = counter.prefixes(text)
    places = range(len(text) + 1) if len(text) < 200 else random.Random(1).sample(range(len(text) + 1), 25)
    for n in places:
        assert table.at(n) == encode(text[:n]), n
    assert counter.count(text) == encode(text)
    if len(text) < 200:
        for budget in (0, 1, 3):
            assert table.longest_within(budget) == max(n for n in range(len(text) + 1) if encode(text[:n]) <= budget)


PARTS = ["a", "the", " Th", " ", "  ", "\n", "\t", "'", "'s", "'ll", "1", "!", "!!", "é", "ñ", "П", "Привет", "日", "本語", "🙂", "\u3000", "\x1c", "\x85", "\u0301", "<|endoftext|>", "<|endof", "τ", "हि"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=10).map("".join))
def test_counts_of_every_prefix_in_any_script(counter, text):
    got = counter.prefix_counts(text).tolist()
    assert got == [len(counter.library.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]


class _Deaf:
    """A tokenizer library that splits, but doesn't encode."""

    def __init__(self, library):
        self.pre_tokenizer = library.pre_tokenizer


@pytest.mark.parametrize("unit", ["x", "П", "日", "  ", "!", "a b ", "Привет, мир! ", "<|endoftext|>", "it's "])
def test_budgets_are_lookups(counter, monkeypatch, unit):
    """No call of the library's encoder, and time in proportion to the length."""
    monkeypatch.setattr(counter, "library", _Deaf(counter.library))

    def seconds(n):
        text, began = unit * (n // len(unit)), time.process_time()
        table = counter.prefixes(text)
        for budget in (0, 10, 100, 1000):
            n = table.longest_within(budget)
            assert table.at(n) <= budget and (n == len(text) or table.counts[n + 1 :].min() > budget)
        return time.process_time() - began

    seconds(2_000)
    few, many = min(seconds(10_000) for _ in range(2)), seconds(80_000)
    assert many < 24 * few + 0.5


def test_stored_tables(counter):
    for text in ODD:
        table = counter.prefixes(text)
        back = tokens.PrefixTable.from_steps(table.steps())
        assert (back.counts == table.counts).all() and back.chars_at(2) == next((n for n, c in enumerate(table.counts) if c >= 2), len(text))


def test_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "_MOST_PIECES", 5)
    monkeypatch.setattr(tokens, "_MOST_PAIRS", 7)
    own = tokens.PrefixCounter(tokens.default_tokenizer())
    for text in ("some words of a text, which has more of them than are kept " * 2, "other ones<|endoftext|>and more<|endoftext|>"):
        assert own.count(text) == len(own.library.encode(text, add_special_tokens=False).ids)
        assert len(own._steps) <= 5 and len(own._fits) <= 7 and len(own._cuts) <= 5


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abTh 's\n1$é'\t", max_size=25))
def test_table_of_pieces(counter, text):
    assert counter.count(text) == len(counter.library.encode(text, add_special_tokens=False).ids)
    for piece in counter.pattern.findall(text):
        assert counter.piece_tokens(piece) == counter.library.encode(piece, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.text(max_size=25), st.sampled_from(ODD)))
def test_encoder_equals_library(text):
    own = packing.encoder(tokens.default_tokenizer())
    assert own.ids(text).tolist() == own.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", [" ", "\n", " \n", "\t", "x", "1", "!", "é", "a ", "\u3000"])
def test_encoder_on_long_runs(unit):
    """Among them runs of white space that would overflow the fast encoder's stack."""
    own = packing.encoder(tokens.default_tokenizer())
    for text in (unit * 2_000_000, "words here" + unit * 4_999 + "and there"):
        assert own.ids(text).tolist() == own.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 30, 3000, 20000])
def test_plans_come_near_the_bound(n):
    r = np.random.default_rng(n)
    lengths = np.clip(np.exp(r.normal(5.5, 1.1, n)), 1, 2047).astype(int)
    ranges, used = packing.plan({int(k): int(c) for k, c in zip(*np.unique(lengths, return_counts=True), strict=True)}, 2048)
    fill, ranks = np.zeros(used, int), {}
    for length, a, b, first, count in ranges:
        assert b - a == count
        fill[first : first + count] += length
        ranks.setdefault(length, []).extend(range(a, b))
    assert fill.min() > 0 and fill.max() <= 2048 and fill.sum() == lengths.sum()
    assert all(sorted(v) == list(range((lengths == k).sum())) for k, v in ranks.items())
    assert used <= 1.001 * -(-lengths.sum() // 2048) + 1 and len(ranges) < 20_000


@pytest.mark.parametrize(("n", "groups"), [(1, 4), (7, 2), (500, 16), (5000, 512)])
def test_packing_plans(n, groups):
    r = np.random.default_rng(n)
    lengths = np.clip(np.exp(r.normal(4.5, 1.0, n)), 1, 511).astype(int).tolist()
    hist = {x: lengths.count(x) for x in set(lengths)}
    large, small = ({k: v for k, v in hist.items() if (k > 64) == big} for big in (True, False))
    fill, used = {}, {}
    for length, a, b, first, count in packing.plan_large(large, 512, groups):
        assert b - a == count
        for k in range(count):
            fill[first + k] = fill.get(first + k, 0) + length
        used.setdefault(length, []).extend(range(a, b))
    assert all(sorted(used[k]) == list(range(v)) for k, v in large.items()) and set(used) == set(large)
    assert not fill or max(fill.values()) <= 512
    order = sorted(fill, key=lambda b: 512 - fill[b])
    gaps = {}
    for b in order:
        gaps[512 - fill[b]] = gaps.get(512 - fill[b], 0) + 1
    plan, new = packing.plan_small(small, gaps, 512)
    total = dict(enumerate(fill[b] for b in order))
    ranks = {}
    for length, a, b, first, count in plan:
        for k in range(count):
            total[first + k] = total.get(first + k, 0) + length
        ranks.setdefault(length, []).extend(range(a, b))
    assert all(sorted(ranks[k]) == list(range(v)) for k, v in small.items())
    assert not total or max(total.values()) <= 512 and len(total) == len(fill) + new
    if n >= 500:
        assert len(total) <= 1.03 * -(-sum(lengths) // 512) + 1


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 32, 576 * 33, 576 * 64 + 5])
def test_media_round_trip(n):
    data = bytes(i * 7 % 251 for i in range(n))
    file = media.store(media.padded(data))
    (track,) = media.tracks(file)
    back = media.payload(file, track)
    assert back == media.padded(data) and len(back) % 576 == 0 and back[: len(data)] == data and set(back[len(data) :]) <= {255}
    assert (track.codec, track.width, track.height, track.duration) == ("raw ", 24, 24, len(back) // 576)
    for k, (a, b) in enumerate(track.key_ranges()):
        assert file[a:b] == back[k * 32 * 576 : k * 32 * 576 + 576]
    assert len(track.key_ranges()) == -(-len(back) // (32 * 576))


def test_media_boxes():
    file = media.store(media.padded(b"x"))
    paths = [b"/".join(p) for p, _, _ in media.boxes(memoryview(file))]
    assert paths[:3] == [b"ftyp", b"mdat", b"moov"] and b"moov/trak/mdia/minf/stbl/stsz" in paths
    assert media.tracks(b"no boxes at all") == [] and media.tracks(file[:-200]) == [] and media.described(None) == []
    listed = media._box(b"moov", media._box(b"trak", media._box(b"free")))
    assert media.tracks(listed) == []


def _changed(file, box, at, value):
    """The file with 32 bits at a place of a box's content replaced."""
    start = next(a for p, a, _ in media.boxes(memoryview(file)) if p[-1] == box)
    return file[: start + at] + struct.pack(">I", value) + file[start + at + 4 :]


def test_hostile_media():
    file = media.store(media.padded(b"x" * 50_000))
    assert len(media.tracks(file)) == 1
    nested = b""
    for _ in range(1_200):
        nested = media._box(b"moov", nested)
    assert media.tracks(nested) == [] and media.tracks(nested + file) and media.described(nested) == []
    for box, at in ((b"stsz", 8), (b"stsz", 4), (b"stsc", 4), (b"stsc", 12), (b"stsc", 8), (b"stco", 4), (b"stco", 8), (b"stss", 4), (b"stss", 8), (b"stts", 4)):
        for value in (0xFFFFFFFF, 0x7FFFFFFF, 0):
            for t in media.tracks(_changed(file, box, at, value)):
                assert len(t.sizes) <= 100 and (t.offsets + t.sizes <= len(file)).all()
    r = random.Random(3)
    for _ in range(300):
        cut = bytearray(file[-900:])
        for _ in range(r.randrange(1, 6)):
            cut[r.randrange(len(cut))] = r.randrange(256)
        media.described(file[:-900] + bytes(cut))


def _two_tracks():
    """A file with a picture track of three frames, shown out of order and edited, and a sound track of two samples."""
    full, box = media._full, media._box
    head = box(b"ftyp", b"isom", bytes(4))
    first = len(head) + 8

    def track(kind, codec, timescale, sizes, times, offsets, more):
        entry = box(codec, bytes(6), b"\0\1", bytes(16), struct.pack(">HH", 320, 240), bytes(50)) if kind == b"vide" else box(codec, bytes(28))
        stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">I", len(times)), *[struct.pack(">II", *t) for t in times]), *more,
                   full(b"stsz", struct.pack(">II", 0, len(sizes)), struct.pack(f">{len(sizes)}I", *sizes)), full(b"stsc", struct.pack(">IIII", 1, 1, 1, 1)), full(b"co64", struct.pack(">I", len(offsets)), struct.pack(f">{len(offsets)}Q", *offsets)))
        edit = box(b"edts", full(b"elst", struct.pack(">IIiIIiI", 2, 1000, -1, 65536, 2500, 10, 65536))) if kind == b"vide" else b""
        return box(b"trak", edit, box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, timescale, 999, 0, 0)), full(b"hdlr", bytes(4), kind, bytes(12)), box(b"minf", stbl)))

    video = track(b"vide", b"avc1", 100, [3, 4, 5], [(2, 40), (1, 60)], [first, first + 3, first + 7], [full(b"ctts", struct.pack(">IIIIIII", 3, 1, 10, 1, 80, 1, 0)), full(b"stss", struct.pack(">III", 2, 1, 3))])
    audio = track(b"soun", b"mp4a", 8000, [6, 6], [(2, 1024)], [first + 12, first + 18], [])
    return head + box(b"mdat", b"aaabbbbcccccddddddeeeeee") + box(b"moov", full(b"mvhd", struct.pack(">IIII", 0, 0, 1000, 3500), bytes(80)), video, audio)


def test_every_track_is_described():
    file = _two_tracks()
    video, audio = media.described(file)
    assert (video["kind"], video["codec"], video["width"], video["height"], video["timescale"], video["n_samples"]) == ("vide", "avc1", 320, 240, 100, 3)
    assert [file[x["start"] : x["end"]] for x in video["key_ranges"]] == [b"aaa", b"ccccc"]
    assert video["duration"] == 250 and video["seconds"] == 2.5 and video["key_times"] == [0, 70] and video["first_shown"] == 0
    t = media.tracks(file)[0]
    assert t.decoded.tolist() == [0, 40, 80] and t.shown.tolist() == [0, 110, 70]
    assert (audio["kind"], audio["codec"], audio["width"], audio["duration"], audio["seconds"], audio["key_times"]) == ("soun", "mp4a", 0, 2048, 0.256, [0, 1024])
    assert media.payload(file, media.tracks(file)[1]) == b"ddddddeeeeee"
    assert not media.fragmented(file) and media.fragmented(file + media._box(b"moof", bytes(8)))


PAGE = "<html><body><div id=top class='menu-bar'><a href=x>Home</a></div><div class=content><h2>Title here</h2><p>Hello, this is a <b>bo</b>ld text. It goes on,&nbsp;and on.<p>Short &lt;1&gt;.</p><p>Another paragraph with words, commas, and so on. Yes.</p><div class=comments><p>First! I agree, totally, with it.</p></div></div><div class='sidebar'>x y z</div><script>var a='<p>no</p>';</script><footer>c</footer></body></html>"


def test_page_text():
    assert pages.main_text(PAGE) == "Title here Hello, this is a bold text. It goes on, and on. Short <1>. Another paragraph with words, commas, and so on. Yes."


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("plain &amp; text\n x", "plain & text x"), ("<p>a", "a"), ("<article><p>one<p>two</article>", "one two"), ("<nav>x</nav>", ""), ("<p>a<!-- never closed", "a"), ("<p>a < b</p>", "a < b"), ("<script>x", ""), ("<p>a<b>c</b><br>d</p>", "ac d")])
def test_odd_pages(page, text):
    assert pages.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p title=\"it's\">Hello</p><p>don't stop</p>", "Hello don't stop"),
        ("<p><img alt=\"John's house\" src=x>a</p><p>b's</p>", "a b's"),
        ("<p data-x='" + "<i>k</i>" * 40 + "' on=\"a>b\">kept</p>", "kept"),
        ("<p title='class=menu id=footer hidden'>kept</p>", "kept"),
        ("<p data-html='<div class=\"menu\">'>kept</p>", "kept"),
        ("<p title=\"open>a</p><p>b</p>", "a b"),
        ("<a href=x?y='1'>a</a>", "a"),
    ],
)
def test_quoted_attributes(page, text):
    assert pages.main_text(page) == text


@pytest.mark.parametrize("shape", ["<div><h1>Title</h1><p>{0}</p><p>{1}</p></div>", "<div><div><h1>Title</h1><p>{1}</p></div><div><p>{0}</p></div></div>", "<body><main><article><h1>Title</h1><p>{0}</p></article><article><p>{1}</p></article></main></body>", "<article><h1>Title</h1><p>{0}</p></article><article><p>{1}</p></article>", "<body><div class=intro><p>{1}</p></div><div class=text><div><p>{0}</p><h1>Title</h1></div></div></body>"])
def test_small_parts_beside_a_large_one(shape):
    long, short = "Many words, one after another. " * 160, "Fewer words, with a <b>bold</b> one. " + "Fewer words, too. " * 18
    got = pages.main_text(shape.format(long, short))
    plain = short.replace("<b>", "").replace("</b>", "")
    assert "Title" in got and long.strip() in got and plain.strip() in got


@pytest.mark.parametrize(
    ("shape", "kept", "gone"),
    [
        ("<div class='layout has-sidebar'>{}<div class=comments><p>{}</p></div></div>", "Title", "First"),
        ("<div class='site header-fixed'><div class=sidebar>First</div><article>{}</article></div><p>crumb {}</p>", "Title", "First"),
        ("<form action=x><input name=y><div>{}</div><div class=menu>{}</div></form>", "Title", "First"),
        ("<div id='search-results-page'><article>{}</article><div id=comments><article>{}</article></div></div>", "Title", "First"),
        ("<div class=sidebar>{}</div><nav>{}</nav>", "Title", "First"),
        ("<div class=text>{}</div><div class=related><article><p>{}</p></article></div>", "Title", "First"),
        ("<div hidden><article>{}</article></div><p>Title is this, with words. </p><div class=menu>{}</div>", "Title is this", "never"),
    ],
)
def test_marked_wrappers(shape, kept, gone):
    first = "never, ever" if gone == "never" else "Title. " + "Words of an article, one after another. " * 30
    got = pages.main_text(shape.format(f"<p>{first}</p>", "First! I agree, never."))
    assert kept in got and (gone not in got or "crumb" in shape) and (gone == "never" or first.strip() in got)


def test_quotes_take_linear_time():
    for page in ("<img b=\">\" " * 50_000 + "='", "<img b='>\"" * 50_000, "<img =" * 50_000, "<img" + " " * 200_000 + "=", "<img b=\">" * 50_001):
        pages.main_text(page)


@pytest.mark.parametrize("unit", ["<", '<a "', "<p>", "<!--", "</b>", "<b>x", "<div>x", "<p><b>x", "<ul><li>x", "<div class=menu>x", "<table><tr><td>x", "<script>", "<form><article>x", "<span><div>x</p>"])
def test_broken_and_deep_pages_take_linear_time(unit):
    def seconds(n):
        page, began = unit * n, time.process_time()
        pages.main_text(page)
        return time.process_time() - began

    seconds(2_000)
    few, many = min(seconds(8_000) for _ in range(3)), seconds(64_000)
    assert many < 32 * few + 0.5  # 8 times the work; with the square of it, 64 times


def _article_page(r, paragraphs, article, wide):
    """A page and its article: menus, adverts and a footer around paragraphs, with or without an article element and class
    words."""
    word = lambda: "".join(r.choice("aeionrstlk") for _ in range(r.randrange(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n)).capitalize()
    own = [line(6)] + [", ".join(line(r.randrange(4, 9)) for _ in range(r.randrange(3, 8))) + "." for _ in range(paragraphs)]
    inner = f"<h1>{own[0]}</h1>" + "".join(f"<p>{x}</p>" for x in own[1:])
    box = {"article": f"<article>{inner}</article>", "div": f"<div class=post>{inner}</div>", "deep": f"<div><section><div>{inner}</div></section></div>"}[article]
    menu, side = "".join(f"<li><a href=x>{word()}</a></li>" for _ in range(r.randrange(4, 12))), f"<div class=c1>{line(3)}</div>"
    around = (f"<ul class=c2>{menu}</ul>{side}", f"<div class=c3>&copy; {line(4)}</div>") if not wide else (f"<nav><ul>{menu}</ul></nav><div class=ad>{line(3)}</div>", f"<footer>&copy; {line(4)}</footer>")
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{around[0]}{box}{around[1]}</body></html>", " ".join(own)


@pytest.mark.parametrize("article", ["article", "div", "deep"])
@pytest.mark.parametrize("wide", [False, True])
def test_ratios_find_the_article(article, wide, monkeypatch):
    """With and without an article element, with and without words that mark what is around it. Without the ratios, all
    paths alike or a random half of them, the texts are other ones."""
    r = random.Random(11)
    made = [_article_page(r, r.randrange(2, 12), article, wide) for _ in range(60)]
    wrong = lambda: sum(pages.main_text(page) != text for page, text in made)
    assert wrong() == 0 if wide else wrong() <= 9  # a footer of some length beside two short paragraphs
    with monkeypatch.context() as m:
        m.setattr(pages, "path_ratios", lambda page, own: np.ones(len(own)))
        assert wrong() > 55
    with monkeypatch.context() as m:
        m.setattr(pages, "content_paths", lambda page, own, marked: {p for p in {page.path[page.at[i]] for i in own} if r.random() < 0.5} or {0})
        assert wrong() > 20


def test_class_words_inside_the_article_drop_nothing():
    words = "Words of an article, one after another. " * 12
    page = f"<body><nav><a>x</a></nav><article><div class='entry-header'><h1>Title</h1></div><p>{words}</p><p class='notice-of-intent'>{words}</p><table class='table-header'><tr><td>Cell one</td></tr></table><p>{words}</p><div class=comments><p>First! I agree.</p></div></article></body>"
    got = pages.main_text(page)
    assert got == f"Title {words}{words}Cell one {words}".strip()


def _patterns(seed, n, share, rates):
    """Counts of vote patterns of n texts, a share of them good; rates: by rule, (bad, good) votes in good and in bad text."""
    r, counts = random.Random(seed), {}
    for _ in range(n):
        good = r.random() < share
        pattern = []
        for k in rules.RULES:
            x, (bad, fine) = r.random(), rates[k][not good]
            pattern.append(-1 if x < bad else 1 if x < bad + fine else 0)
        counts[tuple(pattern)] = counts.get(tuple(pattern), 0) + 1
    return counts


BOTH_WAYS = ("word_length", "sentences", "function_words", "letters", "plain_words")
#: Rules that vote both ways are right nine times in ten; those that only vote bad do so in a third of bad text.
RATES = {k: ((0.05, 0.9), (0.7, 0.15)) if k in BOTH_WAYS else ((0.01, 0.0), (0.35, 0.0)) for k in rules.RULES}


@pytest.mark.parametrize("share", [0.5, 0.8, 0.95])
def test_rule_model_finds_the_rates(share):
    model = rules.fit_patterns(_patterns(4, 6000, share, RATES))
    assert abs(model.prior - share) < 0.03
    for k in rules.RULES:
        for own, (bad, fine) in ((model.good[k], RATES[k][0]), (model.bad[k], RATES[k][1])):
            assert abs(own[0] - bad) < 0.08 and abs(own[2] - fine) < 0.08 and abs(sum(own) - 1) < 1e-9
    assert rules.fit_patterns({}) == rules.VoteModel()


def _votes(**own):
    return [own.get(k, 1 if k in BOTH_WAYS else 0) for k in rules.RULES]


def test_one_bad_vote_is_outweighed_by_several_good_ones():
    """All-must-pass would drop the first two; the model drops them only with more bad votes, or fewer good ones."""
    model = rules.fit_patterns(_patterns(5, 6000, 0.8, RATES))
    assert model.log_odds(_votes(sentences=-1)) > 0 and model.log_odds(_votes(symbols=-1)) > 0
    assert model.log_odds(_votes(symbols=-1, sentences=-1, function_words=-1, letters=-1)) < 0
    assert model.log_odds(_votes(symbols=-1, **dict.fromkeys(BOTH_WAYS, 0))) < 0


def test_the_same_votes_get_the_verdict_that_the_corpus_gives_them():
    pattern = _votes(symbols=-1, sentences=0, letters=0, plain_words=0)
    verdicts = []
    for in_good, in_bad in ((0.4, 0.5), (0.001, 0.8)):
        model = rules.fit_patterns(_patterns(6, 6000, 0.8, RATES | {"symbols": ((in_good, 0.0), (in_bad, 0.0))}))
        verdicts.append(model.log_odds(pattern) > 0)
    assert verdicts == [True, False]


def test_a_rule_that_votes_by_chance_weighs_little():
    model = rules.fit_patterns(_patterns(7, 6000, 0.8, RATES | {"capitals": ((0.2, 0.0), (0.2, 0.0))}))
    _, each = model.weights()
    assert abs(each["capitals"][-1]) < 0.4 < abs(each["symbols"][-1])


def test_language_model():
    r = random.Random(1)
    make = lambda parts: " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(40))
    kinds = {"aa": ["the", "in", "er"], "bb": ["que", "os", "ción"]}
    train = [(make(v), k) for k, v in kinds.items() for _ in range(30)]
    model = langid.fit_texts(*map(list, zip(*train, strict=True)))
    names, scores = model.predict([make(kinds["aa"]), make(kinds["bb"]), "", "123 ..."])
    assert names == ["aa", "bb", "und", "und"] and ((scores >= 0) & (scores <= 1)).all() and scores[2] == 0
    assert langid.fit_texts([], []).predict(["x"])[0] == ["und"]


@pytest.mark.parametrize(("languages", "least"), [(4, 300), (8, 600)])
def test_landmarks_grow_with_the_languages(monkeypatch, languages, least):
    seen, plain = [], langid._products
    monkeypatch.setattr(langid, "_products", lambda left, right: (seen.append(len(right)), plain(left, right))[1])
    texts = [(f"{chr(97 + y) * 3}{chr(97 + i % 26)} {chr(97 + i // 26)}{chr(97 + y)}", str(y)) for y in range(languages) for i in range(90)]
    langid.fit_texts(*map(list, zip(*texts, strict=True)))
    assert seen == [least] and langid.PER_LANGUAGE == 500


def test_packed_presence_is_presence():
    texts = ["a b", "Ünï cödé words", "日本語 text", "x" * 5000]
    assert (langid._vectors([langid.packed(t) for t in texts]) == langid.presence(texts)[0]).all() and langid.packed("1 2") == b""


def test_quality_model_without_negatives():
    r = random.Random(2)
    good = lambda: " ".join(r.choice(["the", "ship", "sails", "over", "a", "sea,", "and", "home."]) + str(r.randrange(3)) * r.randrange(2) for _ in range(60))
    junk = lambda: " ".join(r.choice(["BUY!!", "$$$", "###", "WIN!!"]) for _ in range(60))
    f = lambda texts: np.stack([quality.features(t) for t in texts]).astype(float)
    model = quality.fit_features(f([good() for _ in range(150)]), f([good() for _ in range(240)] + [junk() for _ in range(60)]))
    assert 0.6 < model.prior < 0.95
    # a scorer that only tells positives from all other text would call a fifth of that text's weight bad; the risk is held at 0
    a, b = model.score([good() for _ in range(30)]), model.score([junk() for _ in range(30)])
    assert a.min() >= 0.3 > b.max() and len(model.score([])) == 0
    assert (quality.fit_features(f([""])[:0], f([""])).score(["x", ""]) == 0.5).all()


def test_class_prior():
    r = np.random.default_rng(0)
    p = r.normal(2, 1, 4000)
    u = np.concatenate((r.normal(2, 1, 2800), r.normal(-2, 1, 1200)))
    assert abs(quality.class_prior(quality._histogram(p / 2), quality._histogram(u / 2)) - 0.7) < 0.06


def test_crc_is_the_library_s():
    assert zlib.crc32(b"12") % 5 in range(5)
