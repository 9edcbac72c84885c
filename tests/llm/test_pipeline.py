"""The whole pipeline against plain Python on a small corpus."""

import random
import re
import zlib

import numpy as np

import corpus_pipeline
from wikiloom.llm import tokens
from wikiloom.llm.registry import tokenizer

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "sa") for b in ("ra", "ne", "po", "li", "du", "mo", "ti")]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())


def test_pipeline(spark, tmp_path):
    r = random.Random(4)
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    items = [prose(14) for _ in range(4)]
    texts = {i: prose(r.randrange(30, 200)) for i in range(60)}
    texts[60] = texts[3]  # an exact copy
    changed = texts[5].split()
    changed[len(changed) // 2] = "changed"
    texts[5] = " ".join(changed[: len(changed) // 2] + [prose(150)] + changed[len(changed) // 2 :])
    texts[61] = texts[5] + " tail"  # a near copy
    texts[62] = f"{prose(30)}. {items[0]}, {prose(30)}"
    texts[63] = items[1]
    texts[64] = f"{prose(20)} token = 'zX81kfLq0P99aaB' {prose(20)}"
    for i in range(70, 76):
        texts[i] = f"{prose(20)} password=examplevalue {prose(20)}"
    texts |= {80: None, 81: "", 82: "12 34 !!", 83: prose(3000)}
    rows = [(i, t, "xx" if i % 9 else None, f"s{i}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    want = {i: t for i, t in texts.items() if t and re.search(r"[a-z]", t)}

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = {i: shingles(t) for i, t in want.items()}
    for i in sorted(sets):
        if any(j < i and j in want and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets):
            del want[i]
    assert 60 not in want and 61 not in want
    for i, t in list(want.items()):
        w, hit = words(t), set()
        for item in items:
            iw = words(item)
            for a in range(len(iw) - 9):
                for b in range(len(w) - 9):
                    if w[b : b + 10] == iw[a : a + 10]:
                        hit |= set(range(b, b + 10))
        if 2 * len(hit) >= len(w):
            del want[i]
        elif hit:
            spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
            out, last = "", 0
            for k, (_, b) in enumerate(spans):
                out += "" if k in hit else t[last:b]
                last = b
            want[i] = out + t[last:]
    assert 63 not in want and "token" in want[64]
    want[64] = re.sub(r"token = 'zX81kfLq0P99aaB", "[secret]", want[64])

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = tokens.library(tokenizer("byte_bpe_50k.json"))
    expect = set()
    for i, t in want.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        cut = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        expect |= {(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:], strict=False))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == expect
    used = {}
    for row in got:
        used.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for parts in used.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 2048


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scans", "packing"]
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs.limit(50), sf).columns == docs.columns
