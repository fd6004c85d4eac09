import math
import random

import public_tokenizers
import pytest

from nearfold.llm import sentencepiece_nbest as N

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["the cat", "a\nb", "hello  wörld", "日本x\n\n  é", " x ", "thonre", "a b c d", "aa aa aa", "x y", "no., (yes)!"]


@pytest.fixture(scope="module")
def pieces():
    return N.Pieces(PATH)


def brute(pieces, s):
    """All segmentations, best first."""
    out = []

    def go(i, score, ids):
        if i == len(s):
            out.append((score, ids))
            return
        known = False
        for j in range(i + 1, min(len(s), i + 16) + 1):
            k = pieces.prefixes.get(s[i:j], -1)
            if k >= 0:
                known |= j == i + 1
                go(j, score + pieces.score[k], [*ids, k])
        if not known:
            go(i + 1, score + pieces.unknown, [*ids, *(pieces.byte_ids[b] for b in s[i].encode())])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


@pytest.mark.parametrize("text", TEXTS)
def test_nbest_equals_all_segmentations(pieces, text):
    marked = N.MARK + text.replace(" ", N.MARK)
    every = brute(pieces, marked)
    want = [round(x, 6) for x, _ in every[:4]]
    whole = pieces.nbest(marked, 4)
    assert [round(x, 6) for x, _ in whole] == want
    assert len({tuple(i) for _, i in whole}) == len(whole) and all((round(x, 6), i) in [(round(y, 6), j) for y, j in every] for x, i in whole)
    ids, sizes, best, trips = N.Encoder(pieces, 4).encode_all([text])
    assert [round(x, 6) for x, _ in best[0]] == want
    assert sizes.tolist() == [len(ids)] and trips == [True] and pieces.decode(ids.tolist()) == text.encode()
    rebuilt = [rebuild(ids.tolist(), changes) for _, changes in best[0]]
    assert len(set(map(tuple, rebuilt))) == len(rebuilt)
    assert all((round(x, 6), r) in [(round(y, 6), j) for y, j in every] for (x, _), r in zip(best[0], rebuilt))


def rebuild(ids, changes):
    out, at = [], 0
    for place, drop, instead in changes:
        out += ids[at:place] + list(instead)
        at = place + drop
    return out + ids[at:]


def test_analysis_has_the_best_and_the_loss_of_the_second(pieces):
    rng = random.Random(4)
    for _ in range(150):
        s = N.MARK + "".join(rng.choice("etaonish.,é日") for _ in range(rng.randrange(1, 9)))
        ids, score, loss = pieces.analyse(s)
        two = pieces.nbest(s, 2)
        assert score == pytest.approx(two[0][0])
        assert loss == (pytest.approx(two[0][0] - two[1][0]) if len(two) > 1 else math.inf)


def test_analysis_of_many_words_equals_that_of_each(pieces):
    rng = random.Random(9)
    words = list({N.MARK + "".join(rng.choice("etaonish.,é日\n▁") for _ in range(rng.randrange(0, 14))) for _ in range(600)}) + ["x" * 100, N.MARK]
    ids, size, score, loss = pieces.analyse_many(words)
    want = [pieces.analyse(w) for w in words]
    assert ids.tobytes() == b"".join(x for x, _, _ in want) and (4 * size).tolist() == [len(x) for x, _, _ in want]
    assert score.tolist() == [x for _, x, _ in want] and loss.tolist() == [x for _, _, x in want]


def test_memo_generations_change_nothing(pieces, monkeypatch):
    small, large = N.Encoder(pieces), N.Encoder(N.Pieces(PATH))
    for t in TEXTS * 3:
        monkeypatch.setattr(N, "MEMO_UNITS", 4)
        a = small.encode_all([t, "", t])
        monkeypatch.setattr(N, "MEMO_UNITS", 10**6)
        b = large.encode_all([t, "", t])
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist() and a[2:] == b[2:]


@pytest.mark.parametrize("apart", [True, False])
def test_units_are_the_text(pieces, monkeypatch, apart):
    monkeypatch.setattr(pieces, "lines_apart", apart)
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("ab \n\n.é ") for _ in range(rng.randrange(1, 12)))
        units = N.Encoder(pieces).split(text)
        assert "".join(map(N.lattice_of, units)) == N.MARK + text.replace(" ", N.MARK)
        ids, _, best, trips = N.Encoder(pieces, 4).encode_all([text])
        want = pieces.nbest(N.MARK + text.replace(" ", N.MARK), 4)
        assert [x for x, _ in best[0]] == [x for x, _ in want] and trips == [True]


def test_long_runs_take_linear_time(pieces):
    import time

    began = time.process_time()
    for text in ("=" * 60001, "a" * 60001, "日" * 20000, "\x01" * 20000):
        ids, _, best, trips = N.Encoder(pieces, 4).encode_all([text])
        assert trips == [True] and pieces.decode(ids.tolist()) == text.encode()
        assert [x for x, _ in best[0]] == sorted((x for x, _ in best[0]), reverse=True)
    assert time.process_time() - began < 60


def test_scores_equal_the_library(pieces):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    model = pb.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for text in ("hello world the", "thonre andestion", "segmentation"):
        got = pieces.nbest(N.MARK + text.replace(" ", N.MARK), 4)
        assert [round(x) for x, _ in got] == [round(sum(pieces.score[i] for i in ids)) for ids in library.nbest_encode_as_ids(text, 4)]


def test_documents(docs, texts, no_docs):
    got = N.encode_nbest(docs, PATH).collect()
    assert len(got) == len(texts)
    by = {}
    for r in got:
        by.setdefault(str(r["doc_id"]), []).append(r)
        assert r["n_ids"] == len(r["ids"]) == r["nbest_sizes"][0]
        assert r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True)
        assert len(r["nbest_scores"]) == len(r["nbest_sizes"]) == len(r["nbest_changes"])
        assert [len(rebuild(r["ids"], c)) for c in r["nbest_changes"]] == r["nbest_sizes"]
    assert by["130"][0]["ids"] == [] and by["130"][0]["nbest_scores"] == [0.0] and by["130"][0]["round_trip"]
    assert [str(i) for i, t in texts if t and "▁" in t] == [k for k, rs in by.items() if not all(r["round_trip"] for r in rs)]
    assert N.encode_nbest(no_docs, PATH).count() == 0


def test_segmentations_decode_to_the_text(spark, docs):
    encoded = N.encode_nbest(docs.where("doc_id < 8 or doc_id in (130, 131, 141)"), PATH)
    rows = N.decode_ids(N.segmentations(encoded), PATH).collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id < 8 or doc_id in (130, 131, 141)").collect()}
    want = {(r["doc_id"], i): (s, n, rebuild(r["ids"], c)) for r in encoded.collect() for i, (s, n, c) in enumerate(zip(r["nbest_scores"], r["nbest_sizes"], r["nbest_changes"]))}
    assert {(r["doc_id"], r["place"]): (r["score"], len(r["ids"]), r["ids"]) for r in rows} == want
    assert all(r["decoded"] == text[r["doc_id"]].replace(N.MARK, " ") for r in rows)
    odd = spark.createDataFrame([(1, None, "x"), (2, [], "y")], "doc_id long, ids array<int>, decoded string")
    assert {r["doc_id"]: r["decoded"] for r in N.decode_ids(odd, PATH).collect()} == {1: None, 2: ""}
