"""op13: tokens and groups against the libraries and a plain loop; counts against brute force."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from tidegauge.llm import op13_alignment as op13

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def _plain(texts):
    """Groups of each text by a loop over the libraries' tokens."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    coders = op13.Coders(A, B)
    out = []
    for text in texts:
        groups = []
        if text:
            left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            own = (" " + text).encode()
            if b"".join(coders.a_bytes[i] for i in left) == own == b"".join(coders.b_bytes[i] for i in right):
                i = j = x = y = 0
                group = ([], [])
                while i < len(left) or j < len(right):
                    if x <= y and i < len(left):
                        x += len(coders.a_bytes[left[i]])
                        group[0].append(left[i])
                        i += 1
                    else:
                        y += len(coders.b_bytes[right[j]])
                        group[1].append(right[j])
                        j += 1
                    if x == y:
                        groups.append(group)
                        group = ([], [])
        out.append(groups)
    return out


def _brute(texts):
    split = _plain(texts)
    links = [Counter((x, y) for left, right in groups for x in left for y in right) for groups in split]
    held = Counter(p for link in links for p in link)
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for groups, link in zip(split, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(link.values()), sum(n for p, n in link.items() if held[p] == best[p[0]]),
            sum(n * held[p] for p, n in link.items()), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


def _odd_texts():
    rng = random.Random(13)
    alphabets = ["abc de", "a  \n\t\r", "é ü ñ ß", "0123 ,.", "日本 語の", "́a   ", "🙂👩‍👧 x", "'s't're ll'", "=-", "\x00\x1c\x85 z", "ﬁ①Ⅷ ﷺ"]
    texts = ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += ["".join(chr(c) for c in (rng.randint(1, 0x2FFF) for _ in range(40)) if not 0xD800 <= c < 0xE000) for _ in range(200)]
    return texts + ["<|endoftext|> a<|endoftext|>", "<s> </s> <unk> <0x41>", "a▁b", "  two  spaces  ", " ", "\n", "=" * 3001, "ab" * 2000, "x" * 500 + "日" * 700, "I'm we're it's"]


def test_words_and_tokens_are_the_libraries():
    coders, texts = op13.Coders(A, B), _odd_texts()
    assert coders.cuts
    block = op13.align_block(coders, texts)
    want = [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups) for groups in _plain(texts)]
    assert [g.decode() for g in block["groups"]] == want


def test_link_counts_against_brute_force(spark):
    texts = [None, "", *_odd_texts(), *["the same text again, again"] * 3, "the the the end"]
    docs = spark.createDataFrame([(k // 2, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, row string, `n.best` int").repartition(3)
    want = sorted((k // 2, *r) for k, r in enumerate(_brute(texts)))
    for head in (op13.HEAD_PAIRS, 20, 0):
        got = [tuple(r) for r in op13.link_counts(docs, head=head).collect()]
        assert sorted((r[0], *r[1:]) for r in got) == want


def test_dense_groups_count_the_same(spark, monkeypatch):
    texts = ["ab" * 300, "日" * 90 + "=" * 77, "plain words here"]
    coders = op13.Coders(A, B)
    want = op13.align_block(coders, texts)
    monkeypatch.setattr(op13, "DENSE", 1)
    got = op13.align_block(coders, texts)
    assert got["keys"].tolist() == want["keys"].tolist() and got["times"].tolist() == want["times"].tolist()


def test_long_chains_double():
    import numpy as np

    ends = op13.terminals(np.arange(2, 20_001, 2), np.append(np.arange(1, 20_000, 2), 20_000))
    assert set(ends.tolist()) == {10_000}


def test_groups_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "two words"), (None, None)], "`doc.id` long, text string")
    got = sorted(op13.align(docs, doc_id="doc.id").collect(), key=lambda r: r.n_a)
    assert got[0].groups == "" and got[0].pairs == [] and got[0].groups_sha256 == ""
    assert hashlib.sha256(got[1].groups.encode()).hexdigest() == got[1].groups_sha256
    assert op13.link_counts(docs.where("false"), doc_id="doc.id").count() == 0


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted((d.doc_id, *r) for d, r in zip(docs, _brute([d.text for d in docs]), strict=True))
    assert sorted(map(tuple, op13.op13_alignment(spark, sf).collect())) == want
