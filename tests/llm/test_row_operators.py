"""Operators that work row by row, against plain definitions and the tokenizers' libraries."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lendbook.llm import bpe, html_text, pii, quality
from lendbook.llm.token_counts import PieceCounter

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                doubled = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
                if not 12 <= len(digits) <= 19 or (sum(digits[::-2]) + doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab1407.@+- ()%_é\n", max_size=70))
def test_base_spans_are_the_leftmost_matches(text):
    found = pii.find(text, pii.compiled_kinds())
    assert [(s["kind"], s["start"], s["end"]) for s in found if s["base"]] == base_spans(text)


@pytest.mark.parametrize("text, kind", [
    ("IBAN DE89 3704 0044 0532 0130 00.", "iban"), ("social security 219-09-9999", "ssn"),
    ("call 555 123-4567 now, phone 212 555-0100", "local_phone"), ("imei 490154203237518", "imei"),
    ('token = "04dbebab91ab85687d33eeaaf9"', "secret")])
def test_added_kinds(text, kind):
    assert kind in {s["kind"] for s in pii.find(text, pii.compiled_kinds())}


@pytest.mark.parametrize("text, ibans", [
    ("IBAN ES9121000418450200051332 BIC CAIXESBB", ["ES9121000418450200051332"]),
    ("AT611904300234573201 BIC X", ["AT611904300234573201"]),
    ("AT61 1904 3002 3457 3201 SWIFT", ["AT61 1904 3002 3457 3201"]),
    ("AB12 CDEF DE89 3704 0044 0532 0130 00 IBAN ES9121000418450200051332 AT611904300234573201.",
     ["DE89 3704 0044 0532 0130 00", "ES9121000418450200051332", "AT611904300234573201"]),
    ("IBAN ES9121000418450200051333 BIC CAIXESBB", [])])
def test_account_numbers_before_words_in_capitals(text, ibans):
    found = [s for s in pii.find(text, pii.compiled_kinds()) if s["kind"] == "iban"]
    assert [text[s["start"]:s["end"]] for s in found] == ibans


@pytest.mark.parametrize("text", [
    "DE89 3704 0044 0532 0130 01", "part 219-09-9999", "000-12-3456 ssn"])
def test_checksums_and_context_reject(text):
    assert not {"iban", "ssn"} & {s["kind"] for s in pii.find(text, pii.compiled_kinds())}


def test_redaction(spark):
    from pyspark.sql import functions as F
    rows = pii.detect(spark.createDataFrame([("é mail a@b.cd or +1 (212) 555-0100!",)], "text string"))
    assert rows.select(pii.redact(F.col("text"), F.col("pii"))).first()[0] == \
        "é mail [email] or [phone]!"


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "é"]), max_size=40))
def test_repeated_words(words):
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1
               for k in range(3)}
    assert quality.repeated_words([w.encode() for w in words]) == len(covered)


def test_measures_of_a_text():
    text = "One TWO\tthree###\n\none\nOne TWO\tthree###\x0b \n"
    got = dict(zip(quality.MEASURES, quality.measure_text(text)))
    assert got == {"n_words": 7, "word_chars": 31, "n_symbols": 6, "n_dup_lines": 0, "n_lines": 3,
                   "n_repeat_words": 6, "n_upper_words": 2, "longest_word": 8}


def test_ablations(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (4, 4), (5, 4)], "doc_id long, fail_bits long")
    got = {(r["version"], r["rule"]): (r["rejected"], r["failing"], r["only_this"])
           for r in quality.ablations(rows).collect()}
    assert got["base", "too_few_words"] == (2, 2, 1)
    assert got["base", "repeated_windows"] == (2, 1, 0)
    assert got["v1", "symbols"] == (4, 2, 2)
    kept = [policy.version for policy in quality.POLICIES
            if rows.where(quality.passes(policy, rows["fail_bits"])).count() == 1]
    assert kept == ["v1", "v2"]


def test_ablations_over_the_whole_table(spark):
    from lendbook.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    got = {(r["version"], r["rule"]): (r["rejected"], r["failing"], r["only_this"])
           for r in QUERIES["op3_rule_ablations"](spark, sf).collect()}
    bits = [r["fail_bits"] for r in QUERIES["op3_quality_ledger"](spark, sf).collect()]
    places = {rule.name: 1 << place for place, rule in enumerate(quality.RULES)}
    assert got == {(p.version, name): (
        sum(b & p.mask() != 0 for b in bits), sum(b & places[name] != 0 for b in bits),
        sum(b & p.mask() == places[name] for b in bits))
        for p in quality.POLICIES for name in p.rules}


MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = ["a" * 5000, "  lead  and   trail  " * 50, " " * 300, "▁x▁ " * 200, "日本語テキスト" * 100,
        "x\ty\nz" * 200, "ab" * 777 + " " * 20 + "é😀" * 300, "1234567890" * 100, "\n" * 500]


@pytest.mark.parametrize("chunk, overlap", [(64, 8), (100, 1), (33, 64)])
def test_spliced_counts_are_whole_counts(chunk, overlap):
    counter = PieceCounter(MODEL, chunk, overlap)
    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(7)
    texts = LONG + ["".join(rnd.choice("abeinrst  ,.é\n") for _ in range(900)) for _ in range(150)]
    for text in texts:
        assert counter.count_long(text) == len(pieces.encode(text)), text[:40]
    assert counter.widened > 0


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                       max_pieces=2000, max_states=3000)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=encoder.transducer.ranks)


@settings(max_examples=1500, deadline=None)
@given(text=st.one_of(st.text(max_size=80), st.text(alphabet="aeinrst 'é0\n", max_size=80)))
def test_ids_are_the_librarys(encoder, library, text):
    assert encoder.encode(text).tolist() == library.encode_ordinary(text)


def test_full_tables_try_few_pairs(encoder, library):
    """Without room for states, the pairs of tokens that are asked for stay few."""
    class Counting(bpe.Transducer):
        asked = 0

        def may_follow(self, before, token):
            self.asked += 1
            return super().may_follow(before, token)

    counting = Counting(encoder.transducer.ranks, max_states=1)
    rnd = random.Random(8)
    pieces = ["".join(rnd.choice("aeinrst") for _ in range(60)).encode() for _ in range(50)]
    for piece in pieces:
        assert counting.encode(piece) == library.encode_ordinary(piece.decode())
    assert counting.asked < sum(map(len, pieces))


def test_ids_with_full_tables(encoder, library):
    """More states and pieces than are kept; long pieces."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(300)) for _ in range(150)]
    texts += ["a" * 3000, " " * 3000, "ab" * 2000, "<|endoftext|>" * 3]
    for text in texts:
        assert encoder.encode(text).tolist() == library.encode_ordinary(text)
    assert len(encoder.transducer.members) == 3000 and len(encoder.known) == 2000


@settings(max_examples=800, deadline=None)
@given(ids=st.lists(st.integers(0, 50255), max_size=30), block=st.integers(1, 7))
def test_streamed_decoding_of_any_ids(encoder, ids, block):
    decoder = bpe.StreamDecoder(encoder.transducer.bytes_of)
    whole = b"".join(encoder.transducer.bytes_of[i] for i in ids).decode("utf-8", "replace")
    assert decoder.decode(np.array(ids, np.int32), block) == whole


WEIGHTS = html_text.Weights(
    {"word": 2.0, "link": 0.2, "other": 0.0},
    {"p": -0.01, "h1": -0.01, "b": -0.01, "br": -0.01, "article": -10.0, "div": -4.0, "a": -4.0})


@pytest.mark.parametrize("page, text", [
    ("<p>One  two<p>three &amp; four&nbsp;five", "One two\nthree & four five"),
    ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>a<b>b</b> c<br>d</article>"
     "<footer>f</footer>", "T\nab c d"),
    ("<div class='side-bar'>no no no</div><p>yes yes<div id=comments><p>first!</div>", "yes yes"),
    ("<p>text</p><script>var a='</p>word word word'</script><style>p{}</style>", "text"),
    ("<p>x <form><p>name <input></form> y", "x\ny"), ("<!-- <p>no --><p>a &lt; b < c", "a < b < c"),
    ("", ""), (None, ""), ("<div></div>", ""), ("no tags", "no tags"), ("<p title='>'>a", "a"),
    ("<article><header><h1>Title here</h1><i>by me</i></header><p>words words</article>",
     "Title here\nwords words"),
    ("<p>one<aside><p>two</aside><p>three three", "one\nthree three")])
def test_main_text(page, text):
    assert html_text.main_text(page, WEIGHTS) == text


@pytest.mark.parametrize("names", [
    "page overflow-hidden", "content no-sidebar", "site has-sidebar", "with-menu", "sidebar"])
def test_a_wrapper_does_not_skip_the_article(names):
    page = f"<div class='{names}'><div class=site-footer>no no no</div><article><p>yes yes yes " \
           "yes yes yes yes yes yes yes yes yes</article></div>"
    assert html_text.main_text(page, WEIGHTS) == " ".join(["yes"] * 12)


@pytest.mark.parametrize("names", ["page overflow-hidden", "content no-sidebar", "site has-sidebar"])
def test_a_wrapper_that_only_tells_its_state_is_no_mark(names):
    assert html_text.main_text(f"<div class='{names}'><p>yes yes yes</div>", WEIGHTS) == "yes yes yes"


LINKS = "<ul>" + "".join(f"<li><a href=x>more {i}</a></li>" for i in range(40)) + "</ul>"
MENUS = html_text.Weights({"word": 4.0, "link": 0.2, "other": 0.0}, {
    "p": -0.01, "article": -10.0, "aside": -4.0, "div": -4.0, "a": -4.0, "li": -4.0, "ul": -4.0})


@pytest.mark.parametrize("element", ["article", "main", "section"])
def test_a_large_aside_does_not_cut_the_article(element):
    first, last = "first " * 20, "last " * 200
    page = f"<{element}><p>{first}</p><aside>{LINKS}</aside><p>{last}</p></{element}>"
    assert html_text.main_text(page, MENUS) == f"{first.strip()}\n{last.strip()}"


@pytest.mark.parametrize("element", ["article", "main"])
def test_a_list_of_links_ends_the_article(element):
    page = f"<nav>{LINKS}</nav><{element}><p>{'word ' * 50}</p>{LINKS}</{element}><div>{LINKS}</div>"
    assert html_text.main_text(page, MENUS).split("\n") == [
        ("word " * 50).strip(), *[f"more {i}" for i in range(40)]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=30))
def test_best_region_is_the_greatest_sum(scores):
    start, end = html_text.best_region([float(s) for s in scores])
    best = max([0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)])
    assert sum(scores[start:end]) == best


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="<>/pa \"'!-=&;b", max_size=60))
def test_any_markup_is_read(page):
    html_text.main_text(page, WEIGHTS)
