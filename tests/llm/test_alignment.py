"""Token groups, links and corpus counts of two tokenizers against a plain loop over whole texts."""

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import token_alignment as T
from tidemark.llm.encoders import public_path, space_chunks


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_path(T.TOKENIZER_A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_path(T.TOKENIZER_B)), T.Aligner(public_path(T.TOKENIZER_A), public_path(T.TOKENIZER_B))


def _whole(both, text):
    """(ids a, ids b) of a whole text by the libraries' own encoders."""
    a, b, _ = both
    return a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)


def _brute(both, docs):
    aligner, rows, held = both[2], [], defaultdict(set)
    for n, (doc_id, text) in enumerate(docs):
        a, b = _whole(both, text) if text else ([], [])
        parts_a, parts_b = [aligner.bytes_a[i] for i in a], [aligner.bytes_b[i] for i in b]
        if not text or b"".join(parts_a) != (" " + text).encode() or b"".join(parts_b) != (" " + text).encode():
            rows.append((doc_id, 0, 0, [], []))
            continue
        place = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))]
        at_a, at_b = place(parts_a), place(parts_b)
        links = [(x, y) for x, (s, e) in zip(a, at_a, strict=True) for y, (u, v) in zip(b, at_b, strict=True) if s < v and u < e]
        ends = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, low = [], 0
        for end in ends:
            inside = lambda ids, at: ",".join(str(i) for i, (s, e) in zip(ids, at, strict=True) if low <= s and e <= end)  # noqa: E731, B023
            groups.append(f"{inside(a, at_a)}|{inside(b, at_b)}")
            low = end
        for p in links:
            held[p].add(n)
        rows.append((doc_id, len(a), len(b), groups, links))
    count = {p: len(v) for p, v in held.items()}
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, n_a, n_b, groups, links in rows:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha))
    return sorted(out, key=str)


TEXTS = ["The cat sat. The cat's hat, <|endoftext|>!", "  two  spaces \n and\ttabs ", "naïve café — 数据 🙂🙂", "The cat sat.", "a", " ", "x" * 300, "don't  stop   now", "end space ", "\x1c odd \x85 breaks   here", "no\x00nul", "ﬁ ligature ½ …", "▁under▁bar", None, ""]


@pytest.mark.parametrize("block", [64, 8 << 20])
def test_equals_a_loop(spark, both, block):
    docs = list(enumerate(TEXTS)) + [(None, TEXTS[0]), (3, TEXTS[3]), (3, TEXTS[3])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as block", "2 as kind", "'k' as key").repartition(3)
    got = [tuple(r) for r in T.align(df, block_bytes=block).collect()]
    assert sorted(got, key=str) == _brute(both, docs)


def test_empty_table(spark):
    assert T.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("aB é.,'s \n\t  ▁数🙂0<|>") | st.characters(blacklist_categories=("Cs",)), min_size=1, max_size=30))
def test_chunks_give_the_whole_texts_ids(both, text):
    a, b = _whole(both, text)
    chunks, aligner = space_chunks(text), both[2]
    assert " " + text == "".join(" " + c for c in chunks)
    assert [i for c in chunks for i in aligner.a(" " + c)] == a
    if b"".join(aligner.bytes_b[i] for i in b) == (" " + text).encode():  # else the text has no tokens at all
        assert [i for c in chunks for i in aligner.b.encode(c)] == b
    else:
        assert any(b"".join(aligner.bytes_b[i] for i in aligner.b.encode(c)) != (" " + c).encode() for c in chunks)


def test_what_is_forgotten_is_learnt_again(both, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 3)
    fresh = T.Aligner(public_path(T.TOKENIZER_A), public_path(T.TOKENIZER_B))
    for text in TEXTS[:4] * 2:
        (own,) = fresh.numbered([text])
        whole = T.Aligner.keys_of(fresh, *_whole(both, text), (" " + text).encode())
        assert ";".join(fresh.joined[c] for c in own) == ";".join(whole)
