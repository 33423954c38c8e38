import json
import random
from collections import Counter
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from cohortspark.llm import alignment
from cohortspark.llm.alignment import VOCABULARY_A, VOCABULARY_B, Pair, align_texts, align_tokens, chunks, op13_token_alignment, read_vocabularies, token_groups
from cohortspark.llm.byte_codec import byte_characters
from helpers import awkward_texts, clashing, documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATHS = public_tokenizers.path(VOCABULARY_A), public_tokenizers.path(VOCABULARY_B)
PAIR = Pair(read_vocabularies(*PATHS))
FIRST = Tokenizer.from_file(PATHS[0])
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
VALUE = {c: b for b, c in enumerate(byte_characters())}


def plain_tokens(text):
    """[(id, bytes)] of both sides by the libraries, or nothing."""
    if not text:
        return [], []
    a = [(i, bytes(VALUE[c] for c in FIRST.id_to_token(i))) for i in FIRST.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in SECOND.encode(text):
        piece = SECOND.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if SECOND.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    same = b"".join(x for _, x in a) == whole == b"".join(x for _, x in b)
    return (a, b) if same else ([], [])


def plain(text):
    """(n_a, n_b, n_groups, groups, links) token by token."""
    a, b = plain_tokens(text)
    spans = []
    for side in (a, b):
        at, found = 0, []
        for i, data in side:
            found.append((i, at, at + len(data)))
            at += len(data)
        spans.append(found)
    cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    groups, links, start = [], [], 0
    for cut in cuts:
        inside = [[x for x in side if start <= x[1] and x[2] <= cut] for side in spans]
        groups.append("|".join(",".join(str(i) for i, _, _ in side) for side in inside))
        links += [(i, j) for i, s, e in inside[0] for j, t, f in inside[1] if s < f and t < e]
        start = cut
    return len(a), len(b), len(groups), ";".join(groups), links


TEXTS = [*awkward_texts()[:9], "x" * 300, "a▁b", "<|endoftext|> <s>", "tab\tand  two\n\n lines ", "Ünï çödé 🙂🙂 中文字", " lead", "trail ", "a\x00b"]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="ab'sé 1\n\t .日▁", max_size=60)))
def test_any_text(text):
    found = align_texts([text], PAIR, keep=True)[0]
    n_a, n_b, n_groups, groups, links = plain(text)
    assert (found.n_a, found.n_b, found.n_groups, "".join(found.kept), found.n_links) == (n_a, n_b, n_groups, groups, len(links))
    pairs = {int(p): int(t) for held, times in found.pairs for p, t in zip(held, times)}
    assert pairs == Counter(i * PAIR.n_b + j for i, j in links)


def test_parts_of_long_texts_align_like_the_whole(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "bc", " ", " ", "\n", "Wort", "é", "中", "."]) for _ in range(400)) for _ in range(20)]
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 20)
    assert max(len(chunks(t)) for t in texts) > 5
    for text, found in zip(texts, align_texts(texts, PAIR, keep=True, block=100)):
        n_a, n_b, n_groups, groups, links = plain(text)
        assert (found.n_a, found.n_b, found.n_groups, "".join(found.kept), found.n_links) == (n_a, n_b, n_groups, groups, len(links))
    assert [len(x) for x in align_texts(["y" * 200], PAIR)[0].pairs[0]] != [0, 0]  # no place to cut


def expected(texts):
    found = [plain(t) for t in texts]
    counts = Counter(link for *_, links in found for link in links)
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for n_a, n_b, n_groups, groups, links in found:
        best = sum(counts[x] == highest[x[1]] for x in links)
        total = sum(counts[x] for x in links)
        out.append((n_a, n_b, n_groups, len(links), best, total, sha256(groups.encode()).hexdigest() if groups else ""))
    return out


@pytest.mark.parametrize("block, batch", [(1 << 20, 1 << 24), (64, 300)])
def test_corpus(spark, tmp_path, block, batch):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(["the", "cat", "sat", "Haus", "été", "12", "."]) for _ in range(rng.randint(1, 60))) for _ in range(30)]
    docs = clashing(documents(spark, texts))
    path = str(tmp_path / "documents.parquet")
    docs.repartition(3).write.parquet(path)
    whole = align_tokens(spark.read.parquet(path), *PATHS, most=batch, block=block)
    got = {r.doc_id: r for r in whole.collect()}
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [tuple(got[i][n] for n in names) for i in range(len(texts))] == expected(texts)
    assert {tuple(r) for r in op13_token_alignment(spark, str(tmp_path)).collect()} == {(i, *(got[i][n] for n in names)) for i in got}
    assert set(whole.columns) == {*docs.columns, *names}


def test_groups_repeated_rows_and_no_rows(spark):
    docs = documents(spark, ["twice told", "twice told", None])
    rows = token_groups(docs.union(docs), *PATHS).collect()
    assert sorted((r.n_links, r.groups) for r in rows) == sorted([(len(plain(t)[4]), plain(t)[3]) for t in ["twice told", "twice told", None] * 2])
    assert align_tokens(docs.limit(0), *PATHS).count() == 0
    assert align_tokens(docs.where("text is null"), *PATHS).select("n_a", "groups_sha256").first() == (0, "")


def test_first_side_gives_the_librarys_ids():
    """Every token is what its own bytes are encoded as, so looking a whole pre-token up first changes nothing."""
    read = json.loads(PAIR.json)
    rng = random.Random(2)
    tokens = rng.sample([t for t in read["model"]["vocab"] if t != "<|endoftext|>"], 3000)
    for token in tokens:
        data = bytes(VALUE[c] for c in token)
        try:
            text = data.decode()
        except UnicodeDecodeError:
            continue
        assert PAIR.first.encode_ordinary(text) == FIRST.encode(text, add_special_tokens=False).ids
