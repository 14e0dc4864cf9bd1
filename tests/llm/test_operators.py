"""Each operator against brute force, and on the awkward rows: nulls, empty and long texts, ties, repeats, clashing columns, no rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift.llm import chat_format, decontaminate, html_extract, jaccard_join, line_dedup, mixing_coder, packing, pii, quality_rules, token_counts, token_io, word_bpe
from spindrift.llm.components import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, keep string, n_words long, hits string, n_tokens string, d string, n_email string"
LONG = ("a long text of many words that goes on and on\n" * 3000) + "x" * 70_000
AWKWARD = [None, "", "   ", "\n\n", "a", LONG, "the same line that is long enough\nother", "THE SAME LINE that is long enough\t\nmore", "the same line that is long enough", "the same line that is long enough", "é ß \x1c 🎉 中文 <|endoftext|> </s>"]


def docs_of(spark, texts, ids=None):
    ids = ids or [None if k == 3 else k for k in range(len(texts))]
    return spark.createDataFrame([(i, t, "en", "k", 1, "h", "n", "d", "e") for i, t in zip(ids, texts)], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    df = docs_of(spark, AWKWARD)
    return df.unionByName(df.where("doc_id in (4, 8)"))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(seed=0, n=60):
    """Texts with exact and near copies, shared lines and junk."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(120)]
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared, out = [sentence(8) for _ in range(3)], []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.25:
            words = rng.choice(out).split(" ")
            for _ in range(rng.randrange(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
        else:
            out.append("\n".join(sentence(rng.randrange(1, 40)) if rng.random() < 0.7 else rng.choice(shared) for _ in range(rng.randrange(1, 6))))
    return out


# Line dedup


def brute_lines(rows, min_chars=20, min_docs=3):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(h := holders.get(key(x), ())) >= min_docs and (-1 if i is None else i) != max(h) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


def test_line_dedup(spark, awkward, nothing):
    for df in (awkward, docs_of(spark, corpus(1))):
        got = line_dedup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit(""))).collect()
        assert sorted(map(tuple, got), key=str) == brute_lines([(r["doc_id"], r["text"]) for r in df.collect()])
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_keep_bitmap_is_sparse(spark):
    rows = [(k, "\n".join(["unlike line number %d of %d, long" % (k, i) for i in range(200)] + ["the same line that is long enough"])) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["_ld_doc"]: r["keep"] for r in line_dedup.keep_bitmaps(df).collect()}
    assert sorted(kept) == [0, 1, 2] and all([w["word"] for w in k] == [3] for k in kept.values())


# Quality rules


def brute_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = defaultdict(list)
    for k in range(len(words) - 7):
        seen[tuple(words[k : k + 8])].append(k)
    covered = {p for v in seen.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, awkward, nothing):
    texts = [*AWKWARD, *corpus(2), "a b c d e f g h " * 3, "x " * 30, "# $ a|b <c>"]
    df = docs_of(spark, texts)
    got = quality_rules.text_counts(df).select("text", *quality_rules.BASE).collect()
    for r in got:
        assert tuple(r)[1:] == brute_counts(r["text"]), r["text"]
    assert quality_rules.text_counts(nothing).count() == 0
    found = quality_rules.judge(awkward, quality_rules.DecisionList())
    assert found.where("kept = base_failed").count() == 0


def test_quality_rules_generalise(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    settings = quality_rules.Settings()
    rules = quality_rules.learn(quality_rules.labelled_counts(docs, train, settings), settings)
    assert rules.rules
    judged = quality_rules.judge(docs.join(held, "doc_id"), rules).where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in judged}
    assert n[1, True] >= 0.99 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.9 * (n[0, False] + n.get((0, True), 0))
    none = labels.where("quality = 1")
    assert quality_rules.learn(quality_rules.labelled_counts(docs, none, settings), settings).rules == ()


def test_quality_rules_learn_from_every_label(spark):
    """However many labels there are, none is left out."""
    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence("id", F.col("id") + 24)).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert quality_rules.labelled_counts(docs, labels, quality_rules.Settings()).count() == 25_000


def test_quality_rules_shuffle_no_text(spark, monkeypatch):
    """However many labels there are, counts meet them, not texts; the verdict is the same with the text and without."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    plans, settle = {}, quality_rules.settle
    monkeypatch.setattr(quality_rules, "settle", lambda df, name: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or settle(df, name))
    whole = quality_rules.learn_and_judge(docs, labels)
    assert plans["labelled"].index("Join Inner") < plans["labelled"].index("Generate inline")
    short = quality_rules.learn_and_judge(docs, labels, with_text=False)
    assert short.columns == [c for c in whole.columns if c != "text"] and "text" in whole.columns
    assert short.count() == docs.count() and not short.exceptAll(whole.drop("text")).count()


# HTML


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><ul><li><a>Home</a></li></ul></nav><article><h1>A&amp;B</h1><p>one  <b>two</b><br>three<p>four &lt;x&gt;<script>no</script></article><aside>no</aside><div class='comments'>no</div><footer>no</footer>"
    bare = lambda x: f"<body><div>Shop of things</div><div>{x}</div><div>All rights kept</div></body>"
    rows = [(1, "http://h/a", page, "z"), (2, "http://h/b/1", bare("first story about cats and what they eat all day long, every day"), "z"), (3, "http://h/b/2", bare("second story on dogs, who run in the park in spring and in autumn too"), "z"), (4, None, None, "z"), (5, "http://x/", "", "z"), (5, "http://x/", "", "z"), (None, "::bad[", "<p>loose", "z"), (7, "http://y/1", bare("same"), "z"), (8, "http://y/2", bare("same"), "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"]) for r in html_extract.extract(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "A&B\none two three\nfour <x>"), (2, rows[1][2][36:-39]), (3, rows[2][2][36:-39]), (4, ""), (5, ""), (5, ""), (None, "loose"), (7, "Shop of things\nsame\nAll rights kept"), (8, "Shop of things\nsame\nAll rights kept")], key=str)
    assert html_extract.extract(df.where("false")).count() == 0


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'title="the hidden side"', "data-hidden=1", "title='class=menu'", 'id="story" width="5"', "href=/a/hidden/id=nav", 'data-role="menu"', 'class="x" class="menu"'])
def test_html_reads_whole_attributes_only(attributes):
    assert html_extract.page_text(f"<body><article {attributes}><p>kept</p></article><p>loose</p></body>", None) == "kept"
    assert html_extract.page_text(f"<body><div {attributes}>kept</div></body>", None) == "kept"


@pytest.mark.parametrize("attributes", ["hidden", 'title="a"hidden', "HIDDEN=''", 'aria-hidden = "true"', "id='nav' width='5'", "data-x=1 role=menu"])
def test_html_parts_beside(attributes):
    assert html_extract.page_text(f"<body><div {attributes}>left out</div><p>kept</p></body>", None) == "kept"


def test_html_malformed_pages():
    assert html_extract.page_text("<head><title>x</title><body><article><p>hello", None) == "hello"
    assert html_extract.page_text('<p title=">" class=\'a>b\'>kept</p><p "x>too', None) == "kept\ntoo"
    for part in ('<a "', "<a x='", "<!", "<!--", "</", "<a =", "<p>", "&amp", "<div><p><b>"):
        began = time.perf_counter()
        html_extract.page_lines(part * 50_000)
        assert time.perf_counter() - began < 20, part


def brute_extract(rows):
    """Pages in order of host and path, each against the nearest page on either side that is no copy, by a table of longest common subsequences."""
    from urllib.parse import urlsplit

    pages = sorted(rows, key=lambda r: (urlsplit(r[1]).netloc, urlsplit(r[1]).path, r[0]))
    lines = {r[0]: html_extract.page_lines(r[2]) for r in pages}

    def common(a, b):
        best = [[()] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = (*best[i][j], i) if x == y else max(best[i][j + 1], best[i + 1][j], key=len)
        return best[-1][-1]

    out = {}
    for at, (page, url, _) in enumerate(pages):
        own, gone = lines[page][0], set()
        for side in (pages[max(0, at - 4) : at][::-1], pages[at + 1 : at + 5]):
            for other, url2, _ in side:
                shared = common(own, lines[other][0]) if urlsplit(url2).netloc == urlsplit(url).netloc else None
                if shared is not None and 100 * sum(len(own[k]) for k in shared) < 80 * max(sum(map(len, own)), sum(map(len, lines[other][0]))):
                    gone.update(own[k] for k in shared)
                    break
        out[page] = "\n".join(x for x in own if x not in gone)
    return out


def test_html_differencing_against_brute_force(spark):
    """Pages of one template without any article container, of several hosts, with copies in a row."""
    rng, rows = random.Random(12), []
    for k in range(150):
        host = rng.choice("abc")
        if rows and rng.random() < 0.3:
            page = rng.choice(rows)[2]
        else:
            body = "".join(f"<p>unlike line {k} {i} {rng.random()}</p>" for i in range(rng.randrange(1, 6)))
            page = f"<body><div>Shop {host}</div><div>{rng.choice(['Menu one', 'Menu two'])}</div>{body}<div>All rights of {host}</div>"
        rows.append((k, f"http://{host}.org/{rng.randrange(1000):04d}", page))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, lost string, part string").repartition(7)
    got = html_extract.extract(df)
    assert got.columns == ["page_id", "url", "lost", "part", "text", "n_chars"]
    got, want = {r["page_id"]: r["text"] for r in got.collect()}, brute_extract(rows)
    assert got == want
    # Without differencing, the template would stay.
    assert sum(got[k] != html_extract.page_text(page, None) for k, _, page in rows) > 100


def test_html_differences_pages_that_have_a_container(spark):
    """Lines outside the article that no mark explains: shared ones go, the others are text. The article keeps what pages share."""
    page = lambda k: f"<body><div>Shop</div><nav>menu {k}</nav><h1>Head {k}</h1><article><p>Story {k} of a long and unlike kind</p><p>Les.</p></article><div>All rights</div>"
    rows = [*((k, f"http://h/{k}", page(k)) for k in range(70)), (70, "http://alone/", page(70))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: ("" if k == 70 else f"Head {k}\n") + f"Story {k} of a long and unlike kind\nLes." for k in range(71)}


def test_html_alignment_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found, rest = html_extract.common_lines(a, b), iter(b)
        assert len(found) == table[-1][-1] and all(any(a[k] == y for y in rest) for k in found)


# Personal data


def brute_spans(t):
    email, ip = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    digits = lambda x: re.sub(r"[^0-9]", "", x)
    found = [(m.start(), 0, m.end()) for m in re.finditer(email, t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(ip, t) if all(int(x) < 256 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return sorted(found + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15])


def test_pii_base_spans():
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice("a1.@@+- (b0..45") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert len(pii.base_spans("1" * 200_000)) == 0
    for zeros, last in (("0" * 5000, "1"), ("0" * 5000, "256"), ("9" * 5000, "1")):
        found = [s for s in pii.base_spans(f"{zeros}{last}.1.2.3") if s[1] == 1]
        assert bool(found) == (zeros[0] == "0" and last == "1")


def test_pii_model(spark, awkward, nothing):
    model = pii.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 5000"))
    held = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id between 5000 and 7000").select("text").collect()]
    base, seen = [set(pii.base_spans(t)) for t in held], [{x for x in s if x[1] < 4} for s in pii.model_spans(model, held)]
    hit = sum(len(b & s) for b, s in zip(base, seen))
    assert hit >= 0.7 * sum(map(len, base)) and hit >= 0.6 * sum(map(len, seen))
    found, without = pii.all_spans(model, held), pii.all_spans(None, held)
    assert all(set(own) <= set(every) for own, every in found) and all(own == every for own, every in without)
    # What the model adds on held-out documents: the secrets that their labels name, and little else.
    added = {(k, s) for k, (own, every) in enumerate(found) for s in every if s not in own}
    true = {(k, s) for k, t in enumerate(held) for s in pii.labelled_spans(t) if s[1] == 4}
    assert len(true) > 10 and len(true & added) >= 0.9 * len(true) and len(true & added) >= 0.9 * len(added)
    # Values assigned to names that no label knows.
    unseen = "and then we set bearer = 'f3c9a01b77de4c52aa9001ce62b4d8f0a1b2c3d4' in the file"
    assert [pii.SEEN[k] for _, k, _ in pii.all_spans(model, [unseen])[0][1]] == ["secret"]
    got = pii.find_pii(awkward, model).collect()
    assert len(got) == 13 and all(r["spans"] == "" for r in got)
    assert pii.find_pii(nothing).count() == 0
    assert pii.redact("call +1 (555) 123-4567 now", pii.shown(pii.base_spans("call +1 (555) 123-4567 now"))) == "call [phone] now"


def test_lstm_gradients():
    from spindrift.llm.lstm_crf import Model, pad

    rng, model = np.random.default_rng(0), Model.fresh(4, 3, 5)
    codes, lengths = pad([rng.integers(0, 100, n) for n in (6, 3, 1)])
    tags, _ = pad([rng.integers(0, 4, n) for n in (6, 3, 1)])
    _, grads = model.gradients(codes, lengths, tags)
    for name, at in (("Wf", (1, 2)), ("Ub", (3, 4)), ("T", (1, 2)), ("V", (4, 1)), ("E", (codes[0, 2], 1)), ("bb", (7,))):
        w, e = model.weights[name], 1e-5
        old = w[at]
        losses = []
        for x in (old + e, old - e):
            w[at] = x
            losses.append(model.gradients(codes, lengths, tags)[0])
        w[at] = old
        assert abs((losses[0] - losses[1]) / (2 * e) - grads[name][at]) < 1e-6


# Tokens


@pytest.fixture(scope="module")
def texts():
    return [*AWKWARD, *corpus(4), "it's DON'T 3.5 a\x85b İ. ΑΣ Σ'S  x ﬁ é,"]


@pytest.fixture(scope="module")
def token_ids(texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(word_bpe.default_tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array([*x.ids, 2], "<u4") for x in found]


def test_word_bpe(texts, token_ids):
    ids, sizes = word_bpe.WordBpe(word_bpe.default_tokenizer()).encode(texts)
    assert sizes.tolist() == [len(x) for x in token_ids] and np.array_equal(ids, np.concatenate(token_ids))


@pytest.mark.parametrize("ids", [[], [5], [0] * 5000, list(range(4096)), [1, 2, 3, 700] * 3000, np.random.default_rng(0).integers(0, 65536, 9000).tolist()])
def test_mixing_coder(ids):
    ids = np.array(ids, np.int64)
    prior = mixing_coder.Prior.from_bytes(mixing_coder.Prior.of(ids).to_bytes())
    coded = mixing_coder.encode_blocks(ids, prior)
    sizes = [min(4096, len(ids) - k * 4096) for k in range(len(coded))]
    assert np.array_equal(mixing_coder.decode_blocks(coded, sizes, prior), ids)
    # Each block decodes alone.
    for k, c in enumerate(coded):
        assert np.array_equal(mixing_coder.decode_blocks([c], sizes[k : k + 1], prior), ids[k * 4096 : (k + 1) * 4096])
    shard = token_io.shard_bytes([1, 2], np.array([0, len(ids)]), ids.astype(np.uint16))
    doc_ids, sizes, back = token_io.read_shard(shard)
    assert doc_ids.tolist() == [1, 2] and np.array_equal(back, ids) and sizes.sum() == len(ids)
    if len(ids):
        for at in (25, len(shard) - 3):
            with pytest.raises(ValueError):
                token_io.read_shard(shard[:at] + bytes([shard[at] ^ 1]) + shard[at + 1 :])


def test_mixing_coder_steps(monkeypatch):
    """A quarter of a block's ids are steps, whatever the number of blocks, and stripes of any length come back."""
    ids = np.random.default_rng(1).zipf(1.3, 3 * 4096) % 49152
    prior, steps, predict = mixing_coder.Prior.of(ids), [], mixing_coder._Model.predict
    monkeypatch.setattr(mixing_coder._Model, "predict", lambda self: steps.append(self.lanes) or predict(self))
    coded = mixing_coder.encode_blocks(ids, prior)
    assert steps == [12] * 1024
    assert np.array_equal(mixing_coder.decode_blocks(coded, [4096] * 3, prior), ids) and steps == [12] * 2048
    for n in (1, 2, 3, 5, 6, 7, 63, 64, 65, 4095, 4097, 4098, 8191):
        coded, sizes = mixing_coder.encode_blocks(ids[:n], prior), [4096] * (n // 4096) + [n % 4096] * (n % 4096 > 0)
        assert np.array_equal(mixing_coder.decode_blocks(coded, sizes, prior), ids[:n])
        for i, (c, k) in enumerate(zip(coded, sizes, strict=True)):
            assert np.array_equal(mixing_coder.decode_blocks([c], [k], prior), ids[i * 4096 : i * 4096 + k])
    # The last word of a stripe may carry.
    assert np.frombuffer(mixing_coder._tail(np.uint64(2**64 - 1), np.array([0, 5, 2**32 - 1, 0], np.uint32), 3), "<u4").tolist() == [6, 0, 0]


def test_mixing_coder_compresses(spark, monkeypatch):
    """On real ids: fewer bytes than zlib on the same blocks and than their order-0 entropy; each order lowers the size."""
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    ids, _ = word_bpe.WordBpe(word_bpe.default_tokenizer()).encode(texts)
    prior = mixing_coder.Prior.of(ids)
    size = lambda: len(prior.to_bytes()) + sum(map(len, mixing_coder.encode_blocks(ids, prior)))
    whole = size()
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    assert whole * 8 < -(share * np.log2(share)).sum() * len(ids)
    assert whole < 0.85 * sum(len(zlib.compress(ids[k : k + 4096].tobytes(), 9)) for k in range(0, len(ids), 4096))
    predict = mixing_coder._Model.predict
    for order in (1, 2):
        def without(self, order=order):
            predict(self)
            setattr(self, f"guess{order}", np.full(self.lanes, -1))

        monkeypatch.setattr(mixing_coder._Model, "predict", without)
        assert size() > whole


def test_token_files(spark, texts, token_ids, nothing):
    df = docs_of(spark, texts, [None, *range(1, len(texts))])
    got = token_io.round_trip(df).collect()
    got = sorted(got, key=lambda r: -1 if r["doc_id"] is None else r["doc_id"])
    at = 0
    for r, ids in zip(got, token_ids, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_io.round_trip(nothing).count() == 0
    assert token_io.round_trip(df.unionByName(df)).count() == 2 * len(texts)


def test_packing(spark, texts, token_ids, nothing):
    df = docs_of(spark, texts, list(range(len(texts))))
    for capacity in (4096, 64):
        rows = packing.pack(df, capacity=capacity).collect()
        seen, sequences = defaultdict(list), defaultdict(list)
        for r in rows:
            part = token_ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(token_ids[r["doc_id"]])
            seen[r["doc_id"]].append((r["start"], r["length"]))
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for doc, parts in seen.items():
            assert [s for s, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist() and sum(n for _, n in parts) == len(token_ids[doc])
        assert len(seen) == len(texts)
        for parts in sequences.values():
            assert [o for o, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist() and sum(n for _, n in parts) <= capacity
        assert sorted(sequences) == list(range(len(sequences)))
        assert len(sequences) <= 1.1 * sum(map(len, token_ids)) / capacity + 1
    assert packing.pack(nothing).count() == 0
    assert packing.pack(df.unionByName(df)).agg(F.sum("length")).first()[0] == 2 * sum(map(len, token_ids))


def test_packing_fills(spark):
    """Sequences of sf0.01: within 1 % of the ids over the capacity, and no more than first-fit decreasing on exact lengths plus 1 %."""
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("length", "sequence_id").collect()
    n, total = len({r["sequence_id"] for r in rows}), sum(r["length"] for r in rows)
    assert n * 4096 <= 1.01 * total + 4096


def test_column_generation_covers_and_beats_first_fit():
    """On small problems the linear program is at most first-fit, its bound holds, and every plan covers the demand exactly."""
    rng = np.random.default_rng(5)
    for spread in ((6, 1.0), (7.3, 0.6), (7.6, 0.2)):
        lengths = np.clip(rng.lognormal(*spread, 3000).astype(int), 1, 4095)
        bounds = packing.class_bounds(4096, exact=32, steps=8)
        classes, n = np.unique(np.searchsorted(bounds, lengths), return_counts=True)
        sizes, greedy = np.array(bounds)[classes], sum(t for _, t in packing._first_fit(np.array(bounds)[classes], n, 4096))
        patterns, uses, bound = packing.column_generation(sizes, n, 4096)
        assert (patterns @ sizes <= 4096).all() and np.allclose(patterns.T @ uses, n, atol=1e-3) and bound <= uses.sum() + 1e-6 <= greedy + 1e-3
        plan = packing.make_plan(bounds, dict(zip(classes.tolist(), n.tolist())), 4096)
        assert (plan.patterns @ np.array(bounds) <= 4096).all() and ((plan.patterns * plan.times[:, None]).sum(0)[classes] == n).all()
        assert np.ceil(bound - 1e-6) <= plan.times.sum() <= max(greedy, bound * 1.002 + 3)


def test_column_generation_finds_the_optimum():
    """Lengths that first-fit decreasing packs badly."""
    sizes, demand = np.array([6, 10, 16, 34, 51]), np.array([40, 40, 40, 20, 20])
    patterns, uses, bound = packing.column_generation(sizes, demand, 101)
    worst = sum(t for _, t in packing._first_fit(sizes, demand, 101))
    assert np.allclose(patterns.T @ uses, demand, atol=1e-3) and bound <= uses.sum() <= min(worst, bound + 1 + 1e-6)


def test_token_counts(spark, texts, awkward, nothing):
    import sentencepiece

    rng = random.Random(6)
    more = ["a" * 5000, "ab" * 3000, "the" * 700, "   " * 99, "." * 500 + "=-" * 300, "▁▁ x▁y\x00\x1f", *("".join(rng.choice("aeintsho rdl.,\n") for _ in range(1500)) for _ in range(30))]
    texts = [*texts, *more]
    own = token_counts.PieceMerger(token_counts.default_model())
    library = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    assert own.counts(texts) == [len(x) for x in library.encode([t or "" for t in texts])]
    got = {r["doc_id"]: r for r in token_counts.count_tokens(awkward).collect()}
    assert (got[0]["n_tokens"], got[0]["n_bytes"], got[5]["over_limit"]) == (0, 0, True) and got[5]["n_bytes"] == len(LONG)
    assert token_counts.count_tokens(nothing).count() == 0
    assert token_counts.count_tokens(awkward.withColumnRenamed("keep", "_text")).columns == ["doc_id", "lang", "_text", "n_words", "hits", "d", "n_email", "n_bytes", "n_tokens", "over_limit"]


# Jaccard join


def brute_components(rows, n, percent):
    def grams(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()

    sets = [(i, grams(t)) for i, t in rows]
    home = {i: i for i, _ in rows}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                home[q] = p
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_jaccard_rows_are_handed_on_in_pieces():
    """A task holds the sets of a few megabytes of text, however many rows Spark gives it at once."""
    texts = [" ".join(f"{i}x{k}" for k in range(20_000)) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None, ""]), pa.array(range(62), pa.int64())], ["text", "d"])

    class Table:
        columns = ["text", "d"]

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    how = jaccard_join.Similar(4, 85)
    got = list(jaccard_join._sets(Table(), how)(iter([batch])))
    assert len(got) > 1 and max(sum(len(t) for t in batch["text"].take(b["d"]).to_pylist() if t) for b in got) <= jaccard_join.PIECE_BYTES
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["d"] for r in rows] == list(range(62))
    assert [r["hashes"] for r in rows] == [s.view(np.int64).tolist() for s in jaccard_join.shingles(batch["text"], 4)]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_join(spark, n, percent):
    texts = [*corpus(7, 90), *AWKWARD[:5], "one two", "one two", "ONE TWO", LONG, LONG + " end"]
    base = texts[0] + " " + texts[1] + " " + texts[2] + " " + texts[3]
    words, rng = base.split(), random.Random(8)
    for _ in range(40):
        copy = list(words)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    df = docs_of(spark, texts, list(range(len(texts))))
    how = jaccard_join.Similar(n, percent)
    want = brute_components(list(enumerate(texts)), n, percent)
    assert sorted(map(tuple, jaccard_join.link(df, how).collect())) == want
    if n == 5:
        assert sorted(r["doc_id"] for r in jaccard_join.keep_first(df, how).collect()) == [i for i, _, c in want if i == c]


@pytest.mark.parametrize("held", [1000, 4 << 20])
def test_ngram_order_counts_every_document(spark, monkeypatch, held):
    """The level of each frequent n-gram is that of its count over all documents, however many there are."""
    monkeypatch.setattr(jaccard_join, "HELD", held)
    monkeypatch.setattr(jaccard_join, "LEAST_BITS", 8)
    rng = random.Random(6)
    texts = [None, "", *(" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(rng.randrange(1, 40))) for _ in range(2000))]
    how = jaccard_join.Similar(n=2)
    levels = jaccard_join._levels(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), how)
    counts = Counter(int(h) for own in jaccard_join.shingles(pa.array(texts, pa.string()), 2) for h in own)
    frequent = {h: n.bit_length() - 1 for h, n in counts.items() if n >= jaccard_join.SEEN}
    assert len(levels) >= 2 * len(frequent) > 512
    want = np.zeros(len(levels), np.uint8)
    for h, level in frequent.items():
        at = h >> (65 - len(levels).bit_length())
        want[at] = max(want[at], level)
    assert (levels == want).all()


def test_jaccard_join_awkward(spark, awkward, nothing):
    got = jaccard_join.link(awkward).collect()
    assert len(got) == 13 and Counter(r["component_id"] for r in got)[8] == 3
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert jaccard_join.link(nothing).count() == 0
    two = docs_of(spark, ["a b c d e f g", "h i j k l m n", "h i j k l m n"], [1, 1, 2])
    assert {r["component_id"] for r in jaccard_join.link(two).collect()} == {1}


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100}


# Decontamination


def brute_hits(rows, items, n=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if x := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    found |= x
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_decontaminate(spark, awkward, nothing, block):
    texts = corpus(9, 50)
    items = [(k, " ".join(t.split()[2:18]).upper()) for k, t in enumerate(texts[:8])] + [(90, "goes on"), (91, None), (92, ""), (93, texts[3]), (93, texts[3])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for df in (docs_of(spark, texts), awkward):
        got = decontaminate.find_hits(df, bench, block_bytes=block).select("doc_id", "n_words", decontaminate.n_hit().alias("n"), "items").collect()
        assert sorted(map(tuple, got), key=str) == brute_hits([(r["doc_id"], r["text"]) for r in df.collect()], items)
    assert decontaminate.find_hits(nothing, bench, block_bytes=block).count() == 0
    assert decontaminate.find_hits(awkward, bench.where("false")).where("size(hits) > 0").count() == 0


def test_decontaminate_removes(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    df = spark.createDataFrame([(1, f"before, {item.upper()}! after"), (2, "clean text")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()] == [2]
    assert {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(df, bench, remove="spans").collect()} == {1: "before, ! after", 2: "clean text"}


# Chat


def test_chat_round_trip(spark):
    rng = random.Random(10)
    parts = ["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_", "\n", "\\n", "\\", "user", "ok", "<|", "|>"]
    for _ in range(3000):
        role, text = ("".join(rng.choice(parts) for _ in range(rng.randrange(4))) for _ in range(2))
        whole, a, b = chat_format.render_turn(role, text)
        assert chat_format.parse(whole) == [(role, text)] and chat_format.unescape(whole[a:b]) == text
        assert text not in ("<|im_start|>", "<|im_end|>") or text not in whole[a:b]
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "x"), (None, None, "user", ""), (2, 5, "assistant", "<|im_end|>"), (2, 5, "assistant", "<|im_end|>"), (3, 1, "us\ner", LONG)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat_format.format_turns(df)
    got = {r["conv_id"]: r for r in chat_format.read_back(formatted).collect()}
    for conv in (1, 2, 3, None):
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] or 0))
        want = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(own), hashlib.sha256(want.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r["conv_id"]: r["formatted"] for r in chat_format.whole_conversations(formatted).collect()}
    assert [len(chat_format.parse(whole[c])) for c in (1, 2, 3)] == [3, 2, 1] and len(whole[2]) == got[2]["formatted_chars"]
    assert chat_format.read_back(chat_format.format_turns(df.where("false"))).count() == 0
    for bad in ("x", "<|im_start|>user", "<|im_start|>user\nhi<|im_end|>", "<|im_start|>a\n<|im_start|>b\n<|im_end|>\n"):
        with pytest.raises(chat_format.Malformed):
            chat_format.parse(bad)
