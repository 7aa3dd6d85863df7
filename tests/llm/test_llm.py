"""Operators of veil.llm against brute force on small tables with nulls, repeats, ties and hot values."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import DATA
from veil.llm import catalog
from veil.llm.ann import nearest
from veil.llm.bpe import Encoder, decode_documents, encode_documents
from veil.llm.exact_dedup import exact_duplicates
from veil.llm.extract import common, extract_text, parse
from veil.llm.line_dedup import dedup_lines
from veil.llm.lm import END_BYTE, held_out, score_texts
from veil.llm.ngram_join import similar_documents
from veil.llm.packing import Levels, pack, pack_documents
from veil.llm.token_counts import Unigram, count_tokens, unigram
from veil.llm.toxicity import fit_chain
from veil.llm.vocab import encoding, ranks

RANKS = P.path("byte_bpe_50k.tiktoken")
FIELDS = "doc_id long, text string, lang string, digest string, n long"
NO = ("", None)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["ÀÉ", "ß", "İx"]
    base = [" ".join(rnd.choices(words, k=60)) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, "one two"), (5, "ONE two"), (6, "İstanbul ÀB"),
            (7, "istanbul àb"), (8, "a b c d"), (9, "x" * 5000), (10, "\n\n")]
    for i, b in enumerate(base):
        for j in range(1 + 3 * (i < 3)):
            w = b.split()
            for _ in range(j):
                w[rnd.randrange(len(w))] = "edit%d" % rnd.randrange(999)
            rows.append((100 + 10 * i + j, " ".join(w)))
    rows += [(200 + i, base[0].upper()) for i in range(40)]  # a hot group of copies
    rows += [(300, base[5]), (300, base[6] + " tail"), (301, base[7]), (301, base[7]), (None, base[8])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "xx", "clash", 0) for r in rows], FIELDS).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


def test_oracles(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    for name, sql in catalog.ORACLES.items():
        got, want = catalog.QUERIES[name](spark, DATA), con.execute(sql)
        names = [d[0] for d in want.description]
        cols = sorted(got.columns)
        assert sorted(names) == cols
        theirs = sorted((tuple(r[names.index(c)] for c in cols) for r in want.fetchall()), key=repr)
        assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == theirs


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for out in (exact_duplicates(none), similar_documents(none), dedup_lines(none), score_texts(none),
                pack_documents(none, RANKS, P.PATTERN), count_tokens(none, P.path("piece_bpe_32k.model")),
                encode_documents(none, RANKS, P.PATTERN),
                nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), catalog_query()),
                extract_text(spark.createDataFrame([], "page_id long, url string, html string"))):
        assert out.collect() == []


def catalog_query():
    from pyspark.sql import functions as F

    return F.col("row_id") % 2 == 0


def test_exact_duplicates(docs):
    got = exact_duplicates(docs, fan_in=2).collect()
    groups = defaultdict(list)
    for i, t in corpus():
        groups[lower(t)].append(i)
    assert len(got) == len(corpus())
    want = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in g if i is not None), default=None), len(g))
            for t, g in groups.items()}
    assert all(want[r.text_sha256] == (r.keep_id, r.group_size) for r in got)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(want))
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_similar_documents(docs):
    sets = []
    for i, t in corpus():
        w = lower(t).encode().split()
        sets.append((i, frozenset(zip(w, w[1:], w[2:], w[3:], strict=False)) if len(w) > 3
                     else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(a):
                x, y = sets[a][1], sets[b][1]
                if x and 100 * len(x & y) >= 85 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    least = defaultdict(list)
    for (i, _), r in zip(sets, root, strict=True):
        if i is not None:
            least[r].append(i)
    want = sorted(((i, len(s), min(least[r], default=None) if s else i)
                   for (i, s), r in zip(sets, root, strict=True)), key=repr)
    got = sorted(map(tuple, similar_documents(docs, sketch_bits=12).collect()), key=repr)
    assert got == want


def test_dedup_lines(spark):
    long = "A line that is certainly longer than forty characters."
    rows = [(i, f"own {i}\n  {long.upper() if i % 2 else long}\t\nend") for i in range(1, 8)]
    rows += [(7, long), (20, None), (21, ""), (22, "short\nshort"), (None, long + "\n" + long)]
    got = sorted(map(tuple, dedup_lines(frame(spark, rows)).select(
        "doc_id", "text", "n_lines", "n_dropped", "digest").collect()), key=repr)
    want = [(i, f"own {i}\nend", 3, 1) for i in range(1, 7)]
    want += [(7, rows[6][1], 3, 0), (7, long, 1, 0), (20, "", 1, 0), (21, "", 1, 0), (22, "short\nshort", 2, 0),
             (None, "", 2, 2)]
    assert got == sorted(((*w, "clash") for w in want), key=repr)


def test_packing(docs):
    enc = encoding(RANKS, P.PATTERN)
    want = Counter()
    for i, t in corpus():
        ids = np.array([*enc.encode_ordinary(t or ""), 0], dtype="<u4")
        want[i] += len(ids)
    got = pack_documents(docs, RANKS, P.PATTERN, size=64).collect()
    have, seqs = Counter(), defaultdict(list)
    for r in got:
        have[r.doc_id] += r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    one = pack_documents(docs.where("doc_id = 6"), RANKS, P.PATTERN).collect()
    ids = np.array([*enc.encode_ordinary("İstanbul ÀB"), 0], dtype="<u4")
    assert sum(r.length for r in one) == len(ids) == one[0].doc_tokens
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in one)


def test_special_token_is_matched_as_tokenizers_does():
    from tokenizers import Tokenizer

    text = "a<|endoftext|>b <|endoftext|>"
    enc = encoding(RANKS, P.PATTERN, (("<|endoftext|>", 50256),))
    want = Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert enc.encode_to_numpy(text, allowed_special="all").tolist() == want


def test_sum_of_squares_choice():
    rnd, levels = random.Random(1), Levels(16)
    for _ in range(300):
        n, before = rnd.randint(1, 15), levels.count.copy()
        costs = {}
        for h in range(16 - n + 1):
            if h == 0 or before[h]:
                c = before.copy()
                c[h] -= h > 0
                c[h + n] += h + n < 16
                costs[h] = (c[1:16] ** 2).sum()
        levels.place("p", n)
        assert (levels.count[1:16] ** 2).sum() == min(costs.values())
    sizes = [(i, rnd.randint(1, 60)) for i in range(500)]
    got = Counter()
    for window in pack(iter(sizes), 16):
        for doc, _, n in window:
            got[doc] += n
    assert got == dict(sizes)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=300), st.text(alphabet="ab Aé\n", max_size=600),
                 st.builds(lambda a, n: a * n, st.text(alphabet="abcxyz", min_size=1, max_size=5),
                           st.integers(1, 300))))
def test_bpe_tree_matches_the_library(text):
    enc = test_bpe_tree_matches_the_library.__dict__.setdefault("enc", Encoder(ranks(RANKS), P.PATTERN))
    ids = enc.encode(text)
    assert ids == encoding(RANKS, P.PATTERN).encode_ordinary(text)
    assert enc.tree.decode(ids) == text.encode()


def test_bpe_documents(docs):
    encoded = encode_documents(docs, RANKS, P.PATTERN)
    back = sorted(((r.doc_id, bytes(r.data)) for r in decode_documents(encoded, RANKS).collect()), key=repr)
    assert back == sorted(((i, (t or "").encode()) for i, t in corpus()), key=repr)
    one = catalog.QUERIES["op6_bpe"](docs.sparkSession, DATA).first()
    assert one.n_tokens > 0 and len(one.ids_sha256) == 64


def test_token_counts():
    from tokenizers import Tokenizer, models

    pieces = [("▁a", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁", -3.0), ("ba", -4.0), ("▁▁", -5.0)]
    voc = [*pieces, *((f"<0x{i:02X}>", -99.0) for i in range(256))]
    lib = Tokenizer(models.Unigram([("<unk>", 0.0), *voc], 0, True))
    mine = Unigram([*pieces], True, penalty=10.0 + 99 - 5)
    rnd = random.Random(2)
    for _ in range(500):
        text = "".join(rnd.choices("abé  \n漢", k=rnd.randint(1, 14)))
        assert mine.count(text)[0] == len(lib.encode("▁" + text.replace(" ", "▁")).ids), text
    assert mine.count("") == (0, 0.0)
    full = unigram(P.path("piece_bpe_32k.model"))
    whole = full.viterbi("▁the▁long▁▁house")
    assert full.count("the long  house") == whole


def test_toxicity_held_out(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = [f"n{rnd.randrange(400)}" for _ in range(30)] + (["nastig" + rnd.choice("xyz")] if toxic else [])
        rows.append((i, " ".join("".join(c for c in w if c.isalpha()) + "abcdefghij"[rnd.randrange(10)]
                                 if w.startswith("n") and not toxic else w for w in words)))
        if i < 400:
            labels.append((i, int(i % 3 == 0), int(toxic)))
    rows += [(1000, None), (1001, "")]
    chain = fit_chain(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, junk int, toxic int"),
                      ["junk", "toxic"])
    got = {r.doc_id: r for r in chain.score(frame(spark, rows)).collect()}
    assert len(got) == 602
    right = sum(got[i].toxic == (i % 4 == 0) for i in range(400, 600))
    assert right >= 190
    with pytest.raises(ValueError):
        fit_chain(frame(spark, rows), spark.createDataFrame([], "doc_id long, junk int, toxic int"), ["toxic"])


def test_html():
    page = parse("<html><head><title>t</title></head><body><nav>menu</nav><!-- <p>c</p> --><header>top</header>"
                 "<script>var a='</p>';</script><article><header><h1>Head &amp; line</h1></header>"
                 "<p><b>One<br>two<p>three&nbsp;&#233;<div class='comments'><p>bad</p></div></article>"
                 "<aside>side</aside><form>f</form><footer>foot</footer>")
    assert page.blocks == ["Head & line", "One two", "three é"] and all(page.own)
    assert parse("").blocks == [] and parse("<p>open <b").blocks == ["open <b"]
    assert common(list("abcxd"), list("aybcd")) == {0, 1, 2, 4}


def test_extraction_by_difference(spark):
    page = "<body><div>Menu one</div><p>Text {0} is long enough to be a text of its own.</p><div>Foot</div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(6)]
    rows += [(10, None, None), (11, "http://h.example/x", ""), (12, "http://o.example/1", page.format(12))]
    got = {r.page_id: r for r in extract_text(
        spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}
    assert len(got) == 9 and got[10].text == got[11].text == ""
    assert sum("Menu" not in got[i].text for i in range(6)) >= 4
    assert all(f"Text {i} " in got[i].text and got[i].n_chars == len(got[i].text) for i in (0, 3, 12))


def extracted(spark, rows, parts=1):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len(rows)
    return {r.page_id: r.text for r in got}


def story(seed, n=12):
    return " ".join(random.Random(seed).choices([f"w{i}" for i in range(500)], k=n))


MENU = "".join(f"<div>Menu entry number {i} of the site</div>" for i in range(9))


def test_open_text_beside_an_article(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div>Menu</div><div>{story(i)}</div><article><p>quoted by all</p>"
             f"<p>{story(50 + i)}</p></article></body>") for i in range(4)]
    got = extracted(spark, rows)
    assert got == {i: f"{story(i)}\n\nquoted by all\n\n{story(50 + i)}" for i in range(4)}
    alone = extracted(spark, rows[:1])
    assert alone == {0: f"quoted by all\n\n{story(50)}"}  # nothing to compare with: the markup decides


def test_long_menu_and_copies(spark):
    page = "<body>" + MENU + "{}<div>Foot</div></body>"
    texts = [story(1), *[story(2)] * 5, story(3), *[story(4)] * 3]
    rows = [(i, f"http://h.example/{i}", page.format(f"<p>{t}</p>")) for i, t in enumerate(texts)]
    assert extracted(spark, rows) == dict(enumerate(texts))
    # Near copies: one of nine paragraphs edited. Without another page nothing tells menu and text apart.
    same = "".join(f"<p>{story(i, 30)}</p>" for i in range(8))
    near = [same + f"<p>{story(9, 40)} edit{i}</p>" for i in range(4)]
    rows = [(i, f"http://n.example/{i}", page.format(t)) for i, t in enumerate([*near, f"<p>{story(77)}</p>"])]
    got = extracted(spark, rows)
    assert all("Menu" not in t and "Foot" not in t for t in got.values())
    assert all(story(j, 30) in got[i] for i in range(4) for j in range(8)) and got[4] == story(77)


def test_borders_of_partitions(spark):
    page = "<body>" + MENU + "<p>{}</p><div>Foot</div></body>"
    texts = [story(1), story(2), *[story(3)] * 9, story(4), *[story(5)] * 4]
    rows = [(i, f"http://h.example/{i:03}", page.format(t)) for i, t in enumerate(texts)]
    rows += [(20 + i, f"http://i.example/{i:03}", page.format(story(20 + i))) for i in range(2)]
    want = dict(enumerate(texts)) | {20 + i: story(20 + i) for i in range(2)}
    for parts in (1, 2, 3, 7, 16, 30):
        assert extracted(spark, rows, parts) == want, parts


def test_nearest(spark):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((1500, 16)).astype(np.float32)
    data[300:700] = data[300]  # a third of all rows is one vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [(2000, None), (2002, [0.0] * 16), (2004, [math.nan] + [1.0] * 15), (2006, [None] + [1.0] * 15)]
    from pyspark.sql import functions as F

    got = defaultdict(list)
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"),
                     F.col("row_id") % 50 == 0, block_rows=400, query_rows=16).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, 1500, 50):
        d = np.sqrt(((data.astype(float) - data[q].astype(float)) ** 2).sum(1))
        best = [int(i) for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        hit += len(set(best) & {v for _, v, _ in got[q]})
        assert [r for r, _, _ in sorted(got[q])] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in got[q])
    assert set(got) == set(range(0, 1500, 50)) and hit >= 0.9 * 300


def test_language_model(docs):
    order, rows = 3, [(i, lower(t).encode().split()) for i, t in corpus()]
    text = lambda w: b" " + b"".join(x + b" " for x in w) + bytes([END_BYTE])
    count, tries = Counter(), [defaultdict(Counter) for _ in range(order + 1)]
    for i, w in rows:
        if not held_out(i):
            count.update([*w, None])
            s = text(w)
            for p in range(1, len(s)):
                for j in range(order + 1):
                    tries[j][s[max(0, p - j):p]][s[p]] += 1

    def price(s, p):
        out, total = set(), 0.0
        for j in range(order, -1, -1):
            live = {x: n for x, n in tries[j].get(s[max(0, p - j):p], {}).items() if x not in out}
            if live:
                t = sum(live.values())
                if s[p] in live:
                    return total + math.log10((live[s[p]] - 0.5) / t)
                total += math.log10(0.5 * len(live) / t)
                out |= set(live)
        return total - math.log10(256 - len(out))

    n, v, want = sum(count.values()), len(count), []
    for i, w in rows:
        tokens = [*w, None]
        want.append((i, held_out(i), len(tokens), sum(count[x] > 0 for x in tokens), n,
                     round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens), 6),
                     round(sum(price(text(w), p) for p in range(1, len(text(w)))), 6)))
    got = [(*r[:5], round(r[5], 6), round(r[6], 6)) for r in score_texts(docs, order=order).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    (_, lines), (_, near) = corpus_pipeline.STAGES[1:3]
    kept = lines(spark, docs, DATA)
    assert kept.columns == columns and kept.count() == docs.count()
    left = near(spark, docs, DATA)
    assert left.columns == columns
    groups = similar_documents(docs, k=5, num=80)
    assert (sorted(r.doc_id for r in left.select("doc_id").collect())
            == sorted(r.component_id for r in groups.select("component_id").distinct().collect()))
