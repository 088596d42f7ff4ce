import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemark.llm import token_alignment as T

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers as their libraries give them."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(T.A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=T.B_FILE)
    letters = T.byte_letters()

    def streams(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        of_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        return (ids_a, of_a), (ids_b, of_b)
    return streams


@pytest.fixture(scope="module")
def pair():
    with open(T.A_FILE, "rb") as a, open(T.B_FILE, "rb") as b:
        return T.tokenizers(a.read(), b.read())


def aligned(streams, text):
    """(groups, links) of a text by loops over tokens, or None."""
    if not text:
        return None
    spans = []
    for ids, parts in streams(text):
        if b"".join(parts) != (" " + text).encode():
            return None
        at, out = 0, []
        for i, part in zip(ids, parts, strict=True):
            out.append((i, at, at + len(part)))
            at += len(part)
        spans.append(out)
    a, b = spans
    cuts = sorted({e for *_, e in a} & {e for *_, e in b})
    groups, low = [], 0
    for cut in cuts:
        groups.append(([i for i, _, e in a if low < e <= cut], [i for i, _, e in b if low < e <= cut]))
        low = cut
    return groups, [(i, j) for i, s, e in a for j, t, f in b if max(s, t) < min(e, f)]


def brute(streams, rows):
    found = [(i, aligned(streams, text)) for i, text in rows]
    counts = Counter(link for _, x in found if x for link in x[1])
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    out = []
    for i, x in found:
        if not x:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = x
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def texts():
    rng = random.Random(4)
    words = "alignment tokenizers Überraschung naïve don't we'll 12345 東京 🙂🙃 internationalisation <s> </s> <|endoftext|> <unk> x=y; ...   ▁ <0x0A> ﬁ".split(" ")
    out = [None, "", " ", "  ", "a", "\n\n a\t b ", "<|endoftext|>", "<s>", "▁", "a▁b", "\u0085​ ", "q" * 300, "Ⅷ ①", "﻿x", "é", "\x00a"]
    return out + [rng.choice([" ", "  ", "\n", ""]).join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]


def test_op11(spark, plain):
    rows = [(i, t) for i, t in enumerate(texts())] + [(3, "repeated row"), (3, "repeated row"), (None, "no id"), (999, "long words and more of them " * 400)]
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({"row": F.lit("clash"), "groups": F.lit(1), "chunk": F.lit("clash")})
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute(plain, rows)
    assert sorted((tuple(r) for r in T.op11(df).select(names).collect()), key=str) == want
    # small chunks and pieces, and pairs of which only few are broadcast, give the same
    small = T.Alignment(df, T.A_FILE, T.B_FILE, chunk=37, piece=11).scored(most=20).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    assert sorted((tuple(r) for r in small.select(names).collect()), key=str) == want


def test_empty(spark):
    assert T.op11(spark.createDataFrame([], DOCS)).collect() == []


def test_the_fast_encoder_is_used_and_equal(pair, plain):
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice([chr(rng.randrange(0x20, 0x7F)), chr(rng.randrange(0xA0, T.SETTLED)), " ", "\n", "the", "'s"]) for _ in range(40))
        assert list(pair.encode_a([" " + text])[0]) == plain(text)[0][0]
    assert pair.cuts


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abc  \n.'éß東🙂")) | st.characters(exclude_categories=["Cs"]), min_size=1, max_size=120), st.integers(1, 40), st.randoms(use_true_random=False))
def test_fragments_compose_in_any_order(pair, text, chunk, rng):
    found = T.encoded(pair, [text], 5)[0]
    if found is None:
        return
    a, b = found
    assert T.encoded(pair, [text], 1 << 30)[0][0].tolist() == a.tolist()  # pieces change nothing
    one = T.fragment(a, b, 0, 0, pair.size_a, pair.size_b)
    parts = [T.fragment(*c, pair.size_a, pair.size_b) for c in T.byte_chunks(a, b, pair.size_a, pair.size_b, chunk)]
    while len(parts) > 1:
        k = rng.randrange(len(parts) - 1)
        parts[k:k + 2] = [T.compose(parts[k], parts[k + 1], pair.size_a, pair.size_b)]
    whole = T._settled(parts[0], pair.size_a, pair.size_b, True)
    assert (whole.groups, whole.n, whole.n_groups) == (one.groups, one.n, one.n_groups) and not any(whole.head + whole.tail)
    assert sorted(np.frombuffer(whole.links, np.uint32)) == sorted(np.frombuffer(one.links, np.uint32))
