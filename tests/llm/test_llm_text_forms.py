"""Fill-in-middle, BPE by tree concatenation, alignment of tokenizers: against brute force in plain Python and the libraries."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wikiloom.llm import alignment, bpe, infill, packing, tokens
from wikiloom.llm.registry import tokenizer

DOC = "doc_id long, text string, units string, n string, low string, t string, row string, id string, digest string, block string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, *("clash",) * 8) for i, t in enumerate(texts)], DOC)


TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb\nc\n", "a\nb\nc", "\r\na\r\n\x85b c\n", "x <P> y\nz", "<S>", "a<\nM>\n<M\n>", "é\U0001f600\n" * 50, "a<\n" * 40, "same\ntext\n", "same\ntext\n"]
TEXTS += ["\n".join(f"line {i} {k}" for i in range(k)) for k in range(30)]


def middle_of(i, t, seed=7, rate=100, spm=50):
    t = t or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not t or any(m in t for m in infill.MARKS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, t
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (len(units), "spm", p, m, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", p, m, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("seed,rate,spm", [(7, 100, 50), (3, 40, 0), (3, 0, 50), (11, 90, 100)])
def test_fill_in_middle(spark, seed, rate, spm):
    got = infill.fill_in_middle(docs(spark, TEXTS), seed=seed, rate=rate, spm=spm).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r["n"], r["form"], r["prefix"], r["middle"], r["output"]) == middle_of(i, t, seed, rate, spm)
        assert r["back"] == (t or "")


def test_fill_in_middle_of_odd_rows(spark):
    rows = [(None, "a\nb\n"), (None, "a\nb\n"), (1, None), (2, "line\n" * 200_000), (3, "x" * 2_000_000)]
    made = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    got = made.select("doc_id", "n", "output", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted((r["doc_id"] or 0, r["n"]) for r in got) == [(0, 2), (0, 2), (1, 0), (2, 200_000), (3, 1)]
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)
    assert infill.fill_in_middle(docs(spark, TEXTS).limit(0)).count() == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


WORD = tokenizer("word_bpe_49k.json")
ALPHABETS = ["ab", "lover", "aeiourstlnm'", "'srevmtdl ", "!'s ", "0123 a", "日本語のテキスト", "éàçñß a", "éạ̈ x", "ΣσςΑΩ ", "İıI i", "각가 ", "😀👍🏽a ", "​\x1c\x85\xa0a", "<|endoftext|> a", "#-_=.,:;"]


def library_ids(t):
    return tokens.library(WORD).encode(t or "", add_special_tokens=False).ids


def random_text(seed):
    r = random.Random(seed)
    letters = r.choice(ALPHABETS) + (r.choice(ALPHABETS) if seed % 3 else "")
    return "".join(r.choice(letters) for _ in range(r.randrange(1, 700)))


def test_tree_of_many_texts():
    """Without Spark: leaves of all sizes, windows from one byte on, runs of letters that nothing splits."""
    encoder = bpe.Encoder(WORD, words=True)
    texts = [random_text(i) for i in range(600)] + [w * 90 for w in ("lovelove", "aaaa", "'re'll", "!!!'", "ananas", "́", "in'the", "日本")]
    for i, t in enumerate(texts):
        if any(s in t for s in tokens.specials(WORD)):
            continue
        parts = []
        for x in bpe.halves(t, [1, 2, 3, 7, 20, 64][i % 6]):
            raw, ids, words = bpe.leaf(encoder, WORD, x)
            parts.append(bpe._placed(WORD, raw, ids, words))
        assert bpe.tree(WORD, parts, [1, 4, 16, 64][i % 4]).tolist() == library_ids(t), t


def test_encoded_and_decoded(spark):
    texts = [None, "", " ", "A cat's <|endoftext|> tail", *(random_text(10_000 + i) for i in range(60)), "unsplit" * 700, "ab" * 3000 + " end", "same", "same", "word " * 3000, "x<|startoftext|>" * 900]
    got = {r["doc_id"]: r for r in bpe.encoded(docs(spark, texts), WORD, leaf_chars=100).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library_ids(t)
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == tokens.library(WORD).decode(ids, skip_special_tokens=False)
    assert bpe.encoded(docs(spark, texts).limit(0), WORD).count() == 0
    rows = spark.createDataFrame([(None, "b" * 300), (None, "b" * 300), (None, None), (5, "c" * 300), (5, "c" * 300)], "doc_id int, text string")
    got = bpe.encoded(rows, WORD, leaf_chars=100).collect()
    assert len(got) == 5 and sorted(r["n_tokens"] for r in got) == sorted(len(library_ids(t)) for t in ("b" * 300, "b" * 300, "", "c" * 300, "c" * 300))


def test_packing_of_a_huge_pre_token_and_odd_sizes(spark):
    path = tokenizer("byte_bpe_50k.json")
    out = packing.pack(spark.createDataFrame([(1, "\U00020001" * 262_145)], "doc_id long, text string"), path).collect()
    assert sum(r["length"] for r in out) == 4 * 262_145 + 1
    counts = np.random.default_rng(3).integers(0, 50, 2001)
    for size in (1, 7, 100, 300, 1000, 2000):
        placed = np.zeros(size + 1, np.int64)
        for lengths, times in packing.plan(counts[: size + 1], size):
            assert sum(lengths) <= size
            np.add.at(placed, list(lengths), times)
        assert (placed[1:] == counts[1 : size + 1]).all()


A_PATH, B_PATH = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def links_of(t, tok, model):
    """A's and B's (id, end in bytes) by the libraries, one token at a time; None where bytes are lost."""
    byte_of = tokens._byte_of()
    a = [(i, bytes(byte_of[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + t, add_special_tokens=False).ids]
    b = [(i, bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("\u2581", " ").encode()) for i in model.encode(t)]
    want = (" " + t).encode()
    if not t or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return None
    ends = []
    for side in (a, b):
        at, out = 0, []
        for i, x in side:
            at += len(x)
            out.append((i, at))
        ends.append(out)
    return ends


@pytest.mark.parametrize("stripes,digest", [(128, True), (3, False)])
def test_alignment(spark, stripes, digest):
    from collections import Counter

    from tokenizers import Tokenizer

    tok, (model, apart) = Tokenizer.from_file(A_PATH), alignment.pieces(B_PATH)
    tok.encode_special_tokens = True
    assert apart
    texts = [None, "", " ", "a", "the cat  sat\n\n on   the mat ", "x \u2581 y", "\u2581", "<s> </s> <|endoftext|><0x41>", "\x00 a\x00", *(random_text(50_000 + i) for i in range(80)), "the " * 4000, "unsplit" * 900, "same words here", "same words here", " lead", "\ttab\u00a0nbsp \u3000", "ﬁ ① Ａ"]
    made = {i: links_of(t or "", tok, model) for i, t in enumerate(texts)}
    count, links = Counter(), {}
    for i, x in made.items():
        links[i] = [(p, q) for p, e in x[0] for q, f in [(q, f) for q, f in x[1] if f == e]] if x and len(x[0]) < 2500 else []
        if x and len(x[0]) >= 2500:
            at = {e: p for p, e in x[0]}
            links[i] = [(at[f], q) for q, f in x[1] if f in at]
        count.update(links[i])
    best = {}
    for (_, q), n in count.items():
        best[q] = max(best.get(q, 0), n)
    got = {r["doc_id"]: r for r in alignment.aligned(docs(spark, texts).repartition(3), A_PATH, B_PATH, stripes=stripes, digest=digest).collect()}
    assert len(got) == len(texts)
    for i, x in made.items():
        r, groups = got[i], []
        if x:
            (a, b), both = x, sorted({e for _, e in x[0]} & {e for _, e in x[1]})
            ia = ib = 0
            for e in both:
                ja, jb = ia, ib
                while ja < len(a) and a[ja][1] <= e:
                    ja += 1
                while jb < len(b) and b[jb][1] <= e:
                    jb += 1
                groups.append(",".join(str(p) for p, _ in a[ia:ja]) + "|" + ",".join(str(q) for q, _ in b[ib:jb]))
                ia, ib = ja, jb
        said = ";".join(groups)
        assert r["groups"] == (hashlib.sha256(said.encode()).hexdigest() if digest and said else said), texts[i]
        want = (len(x[0]), len(x[1])) if x else (0, 0)
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (*want, len(groups), len(links[i]))
        assert (r["n_best"], r["count_sum"]) == (sum(count[p] == best[p[1]] for p in links[i]), sum(count[p] for p in links[i]))


def test_alignment_of_odd_tables(spark):
    assert alignment.aligned(docs(spark, TEXTS).limit(0), A_PATH, B_PATH).count() == 0
    assert [tuple(r) for r in alignment.aligned(spark.createDataFrame([(None, None)], "doc_id int, text string"), A_PATH, B_PATH).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")]
    rows = alignment.aligned(spark.createDataFrame([(1, "same text")] * 3, "doc_id int, text string"), A_PATH, B_PATH).collect()
    assert len(rows) == 3 and len(set(rows)) == 1 and rows[0]["count_sum"] == 3 * rows[0]["n_links"]
