"""Words, hashes, the coder and the permutations, without Spark."""

import datetime as dt
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import brute
from sojourn.llm import common, decontaminate, idstream, language, licenses, pseudonyms, quality, repeats

TEXTS = st.lists(st.one_of(st.text(max_size=40), st.text("ab \n\té", max_size=80)), max_size=6)


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    w = common.words_of(pa.array(texts, pa.string()))
    found = [[w.data[w.starts[i] : w.ends[i]].tobytes().decode() for i in range(a, b)] for _, a, b in common.bounds(w.first)]
    assert found == [brute.words(t) for t in texts]


def test_word_hashes_know_words_only_by_their_bytes():
    w = common.words_of(pa.array(["one two one", "two ONE"], pa.string()))
    plain, folded = common.word_hashes(w), common.word_hashes(w, fold=True)
    assert plain[0] == plain[2] != plain[4] and plain[1] == plain[3] and len(set(plain.tolist())) == 3
    assert folded[0] == folded[4]


@given(st.lists(st.text("abcab", min_size=1, max_size=30), min_size=1, max_size=4), st.text("abcx", min_size=1, max_size=60))
@settings(max_examples=150, deadline=None)
def test_cross_parsing_counts_longest_phrases(pieces, text):
    parser = language.CrossParser({"l": pieces})
    count, size = parser.phrases(pa.array([text], pa.string()))
    assert size[0] == len(text) and count[0][0] == brute.phrases(pieces, text)


@given(st.lists(st.lists(st.integers(0, 6) | st.integers(0, 60000), max_size=300), max_size=5))
@settings(max_examples=100, deadline=None)
def test_blocks_round_trip(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    back = idstream.decode_blocks(idstream.encode_blocks(blocks))
    assert [b.tolist() for b in back] == [b.tolist() for b in blocks]


def test_blocks_use_what_repeats_and_find_damage():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 49408, 200).astype(np.uint32)
    repeated = np.tile(ids, 20)
    (once,), (again,) = idstream.encode_blocks([rng.permutation(repeated)]), idstream.encode_blocks([repeated])
    assert len(again) < len(once) / 3
    for place in (5, len(again) // 2, len(again) - 1):
        damaged = bytearray(again)
        damaged[place] ^= 1
        with pytest.raises((ValueError, IndexError)):
            idstream.decode_blocks([bytes(damaged)])


def test_blocks_take_little_memory():
    rng = np.random.default_rng(5)
    blocks = [rng.integers(0, 600, 4096).astype(np.uint32) for _ in range(256)]
    coded = idstream.encode_blocks(blocks)
    for step, given in ((idstream.encode_blocks, blocks), (idstream.decode_blocks, coded)):
        tracemalloc.start()
        step(given)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 18 * 256 * 4096


def test_pieces_of_words_are_encoded_once(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["Foo, foo. (FOO) a12 12a", "", " \t ", "***foo İstanbul ÉCOLE. don't <|endoftext|> <|ENDOFTEXT|>", "x—y ΟΔΟΣ. ́a ﬁ #!$ b\x1cc"]
    wanted = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    monkeypatch.setattr(idstream, "MEMO_PIECES", 4)
    idstream._memo.cache_clear()
    assert idstream.encode_texts(pa.array(texts[:1]), path) == wanted[:1]
    memo = idstream._memo(path)
    assert b"foo" in memo and b"Foo," not in memo and len(memo) < 12
    for _ in range(3):
        assert idstream.encode_texts(pa.array(texts), path) == wanted
        assert [idstream.encode_texts(pa.array([t]), path)[0] for t in texts] == wanted
    assert len(memo) + len(memo.before) < 60
    idstream._memo.cache_clear()


def test_plain_pieces_need_no_normalizer(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = np.random.default_rng(7)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 12))) for _ in range(700)]
    texts = [" ".join(words), "Ab,c!! 123 x-y_z {[(~)]} école don't a\tb", "".join(words)]
    wanted = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    rest, before = [], idstream._learn_pieces
    monkeypatch.setattr(idstream, "_learn_pieces", lambda known, pieces, path: (rest.extend(pieces), before(known, pieces, path)))
    idstream._memo.cache_clear()
    assert idstream.encode_texts(pa.array(texts), path) == wanted
    assert sorted(x for x in rest if not x.isspace()) == ["don't".encode(), "école".encode()]
    idstream._memo.cache_clear()


def test_latin_letters_are_split_and_need_no_normalizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["École, (école) ÉCOLE! Straße×2", "naïve÷ÿ ŒUVRE Åé", "Été\u0301s cafe\u0301 l'été ªé µ\xad \x85à", "À" * 40]
    wanted = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    idstream._memo.cache_clear()
    assert idstream.encode_texts(pa.array(texts), path) == wanted
    memo = idstream._memo(path)
    assert "école".encode() in memo and "École,".encode() not in memo and b" " not in memo
    assert "Straße×2".encode() in memo and "Été\u0301s".encode() in memo  # other signs leave a word whole
    idstream._memo.cache_clear()


def test_predictions_of_known_symbols_are_those_of_the_slots():
    rng = np.random.default_rng(9)
    symbols = rng.integers(0, 4, (3, 200)).astype(np.int16)
    symbols[1] = np.tile(symbols[1, :5], 40)
    slots = np.zeros_like(symbols)
    slots[:, 1:] = symbols[:, :-1]
    found = idstream._remembered(slots, symbols)
    for row, of_slots, coded in zip(symbols.tolist(), slots.tolist(), found.tolist()):
        held = {}
        for symbol, slot, code in zip(row, of_slots, coded):
            guess, run = held.get(slot, (0, 0))
            assert code & 7 == run and (not run or code >> 3 == (guess == symbol) + 2 * (guess < symbol))
            held[slot] = symbol, min(run * (guess == symbol) + 1, 7)


def test_batches_are_put_together():
    sizes = [3, 5, 4, 300, 1, 1]
    batches = [pa.record_batch({"text": ["x" * n]}) for n in sizes]
    found = list(idstream._together(iter(batches), 20 + 2 * batches[0].nbytes))
    assert [len(x) for b in found for x in b.column("text").to_pylist()] == sizes and 1 < len(found) < len(sizes)
    assert list(idstream._together(iter([]), 5)) == []


def test_long_and_uniform_blocks():
    blocks = [np.full(4096, 49407, np.uint32), np.arange(4096, dtype=np.uint32), np.zeros(1, np.uint32)]
    assert [b.tolist() for b in idstream.decode_blocks(idstream.encode_blocks(blocks))] == [b.tolist() for b in blocks]


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1000])
def test_feistel_permutes(size):
    network = pseudonyms.Feistel(b"k", size, "t")
    image = [network(i) for i in range(size)]
    assert sorted(image) == list(range(size)) and [network.inverse(x) for x in image] == list(range(size))
    if size >= 100:
        assert image != [pseudonyms.Feistel(b"other", size, "t")(i) for i in range(size)]


def _permute(value, size, tweak):
    return pseudonyms.Feistel(b"key", size, tweak)(value)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("4111 1111 1111 1111", "card"), ("4111111111111111", "card"), ("378282246310005", "card"),
        ("+1 (555) 010-9999", "phone"), ("555-010-9999", "phone"), ("078-05-1120", "social"),
        ("192.168.0.12", "address"), ("DE89370400440532013000", "iban"), ("GB82 WEST 1234 5698 7654 32", "iban"),
        ("2024-02-29", "date"), ("31.12.1999", "date"), ("12/31/1999", "date"), ("Ann.b7@mail.example.com", "mail"),
    ],
)
def test_pseudonyms_keep_format_and_validity(text, kind):
    new, found = pseudonyms.pseudonymised(f"see {text}, there", _permute)
    assert [f[0] for f in found] == [kind] and found[0][1:] == (4, 4 + len(text))
    value = new.removeprefix("see ").removesuffix(", there")
    assert value != text and pseudonyms.pseudonymised(f"({value})", lambda v, n, t: v) == (f"({value})", [(kind, 1, 1 + len(value))])
    if kind != "address":
        assert [c if not c.isalnum() else "x" for c in value] == [c if not c.isalnum() else "x" for c in text]


def test_equal_values_stay_linked_and_invalid_ones_stay():
    one, _ = pseudonyms.pseudonymised("4111 1111 1111 1111", _permute)
    two, _ = pseudonyms.pseudonymised("card 4111111111111111.", _permute)
    assert one.replace(" ", "") == two[5:-1]
    for text in ("4111 1111 1111 1112", "0000000000000000", "2023-02-29", "300.1.1.1", "000-12-3456", "v1.2.3.4.5", "DE00370400440532013000", ""):
        assert pseudonyms.pseudonymised(text, _permute) == (text, [])
    day, _ = pseudonyms.pseudonymised("2024-02-29", _permute)
    other, _ = pseudonyms.pseudonymised("29.02.2024", _permute)
    assert dt.date.fromisoformat(day) == dt.datetime.strptime(other, "%d.%m.%Y").date()


@given(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.lists(st.integers(0, 3), min_size=1, max_size=16))
@settings(max_examples=150, deadline=None)
def test_alignment_matches_the_plain_recurrence(item, passage):
    left, right = (np.array(x, np.uint64) + np.uint64(5) for x in (item, passage))
    best, end = decontaminate.align([left], [right])
    assert best[0] == brute.alignment(item, passage)


@given(st.lists(st.integers(0, 50), min_size=1, max_size=80), st.integers(1, 20))
@settings(max_examples=100, deadline=None)
def test_first_minimum_of_each_run(values, width):
    found = repeats._first_minimum(np.array(values, np.uint64), width)
    for i in range(len(values) - width + 1):
        run = values[i : i + width]
        assert found[i] == run.index(min(run))


def test_bands_are_as_sure_as_they_say():
    assert 1 - (1 - licenses.LEAST_CONTAINMENT / 5) ** licenses.bands() >= licenses.CERTAINTY


def test_templates_are_found_in_any_place():
    rng = np.random.default_rng(4)
    known = licenses.Templates(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        for at in rng.integers(0, 300, 20):
            filling = [f"w{i}" for i in rng.integers(0, 10**6, 400)]
            hashes, first = licenses._shingles(pa.array([" ".join([*filling[:at], text, *filling[at:]])], pa.string()))
            assert known.names.index(name) in {t for t, _, _ in known.candidates(hashes, first)}


def test_factorisation_machine_sums_all_pairs():
    """The linear-time score equals the sum over pairs of features."""
    rng = np.random.default_rng(5)
    machine = quality.FactorisationMachine()
    machine.words[:, 0] = rng.normal(size=len(machine.words))
    machine.words[:, 1:] = rng.normal(size=machine.words[:, 1:].shape)
    machine.stats[:] = rng.normal(size=machine.stats.shape)
    words, stats = rng.integers(0, 1 << quality.WORD_BITS, 9), rng.normal(size=len(quality.STATISTICS))
    x = np.concatenate((np.full(9, 1 / 3), np.clip(stats, -4, 4)))
    weights = np.concatenate((machine.words[words], machine.stats))
    logit = machine.bias + weights[:, 0] @ x
    for i in range(len(x)):
        for j in range(i):
            logit += weights[i, 1:] @ weights[j, 1:] * x[i] * x[j]
    found = machine.score(words, np.array([0, 9]), stats[None])
    assert found[0] == pytest.approx(1 / (1 + np.exp(-np.clip(logit, -30, 30))), rel=1e-4)


def test_memory_of_texts_goes_back_when_they_end(monkeypatch):
    given = []
    monkeypatch.setattr(common, "release_unused", lambda: given.append(1))
    batches = [pa.record_batch({"text": ["a", None, "b" * 50]}) for _ in range(3)]
    assert [len(texts) for _, texts in common.text_slices(iter(batches), limit=20)] == [2, 1] * 3 and given == [1]
