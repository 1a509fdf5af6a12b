import itertools
import random
from collections import Counter

import pytest
import regex as re

from foreign_texts import labelled

from loamgraph.llm import pii
from loamgraph.llm.pii_sample import labelled_sentences
from loamgraph.sources.tables import table


@pytest.fixture(scope="module")
def model():
    return pii.model()


def found(text, model):
    return [(k, text[s:e]) for s, e, k in pii.decode(text, model)]


def accuracy(examples, model):
    """Precision and recall of each kind."""
    hit, more, less = Counter(), Counter(), Counter()
    for text, gold in examples:
        got = set(pii.decode(text, model))
        hit.update(k for *_, k in got & set(gold))
        more.update(k for *_, k in got - set(gold))
        less.update(k for *_, k in set(gold) - got)
    return {k: (hit[k] / max(1, hit[k] + more[k]), hit[k] / max(1, hit[k] + less[k])) for k in pii.KINDS}


def runs(text, n=5):
    w = [x.lower() for x in re.findall(r"[\p{L}\p{N}]+", text)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_sample_shares_no_wording_with_the_documents(spark, data_dir):
    """Neither training sentences nor foreign texts have five words in a row that stand in a document."""
    sample = {x for t, _ in labelled_sentences(pii.TRAIN_SENTENCES, pii.lexicon()) for x in runs(t)} | {x for t, _ in labelled() for x in runs(t)}
    held = {x for r in table(spark, data_dir, "documents").select("text").where("text is not null").toLocalIterator() for x in runs(r.text)}
    assert held and not sample & held


def test_foreign_wording(model):
    """Hand-labelled texts that share no wording with the sample; the README has the figures of each kind."""
    own = {x for t, _ in labelled_sentences(pii.TRAIN_SENTENCES, pii.lexicon()) for x in runs(t)}
    assert not own & {x for t, _ in labelled() for x in runs(t)}
    for kind, (precision, recall) in accuracy(labelled(), model).items():
        print(f"{kind}: precision {precision:.3f}, recall {recall:.3f}")
        assert precision >= 0.9 and recall >= 0.85, kind


def test_true_spans_are_candidates():
    sample = labelled_sentences(1500, pii.lexicon(), seed=5)
    missed = [x for x, gold in sample if not set(gold) <= set(pii.candidates(x))]
    assert len(missed) < 0.005 * len(sample)


def test_every_email_spelling_is_a_candidate():
    """Whether an address is proposed doesn't depend on what else the text holds."""
    at = ["@", " @ ", "＠", "[at]", " [AT] ", "(At)", " {ät} ", "<arroba>", " (@) ", "&#64;", "&#x40;", "&commat;", "%40", " at ", " AT "]
    dot = [".", "．", "[dot]", " (DOT) ", " {punkt} ", " [.] ", " dot ", " DOT "]
    for a, d in itertools.product(at, dot):
        piece = f"jane.doe{a}mail-x{d}example{d}org"
        text = f"write to {piece} soon"
        assert pii.EMAIL.search(text), text
        assert (9, 9 + len(piece), "email") in pii.candidates(text), text


@pytest.mark.parametrize(
    ("piece", "before", "kind"),
    [
        ("4 1 5 5 5 5 0 1 3 4", "call ", "phone"),
        ("415 555 0134", "row 1 22 333 44 55 66 77 ", "phone"),
        ("(415) 555-0134", "row 1 22 333 44 55 66 77 ", "phone"),
        ("Maria del Carmen de la Cruz Garcia", "signed by ", "name"),
        ("12 Old St. Mary of the Green Hill Farm Road".replace("of the", "de la"), "at ", "address"),
    ],
)
def test_only_the_length_bounds_a_candidate(piece, before, kind):
    start = len(before)
    assert (start, start + len(piece), kind) in pii.candidates(f"{before}{piece} now")


def test_held_out_accuracy(model):
    for kind, (precision, recall) in accuracy(labelled_sentences(1500, model.words, seed=77), model).items():
        assert precision > 0.92 and recall > 0.92, kind


def test_brackets_around_a_number_stay_outside():
    assert (10, 26, "phone") in pii.candidates("Contact: (+353 861 234 567)")


def test_an_address_of_any_length_is_an_email(model):
    piece = "a" * 120 + "@" + "b" * 90 + ".example.org"
    assert found(f"write to {piece} soon", model) == [("email", piece)]


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_and_marginals_against_enumeration(seed):
    """On small lattices the dynamic programs agree with all span sets written out."""
    import math

    r = random.Random(seed)
    spans = []
    for _ in range(7):
        s = r.randrange(10)
        spans.append((s, s + r.randint(1, 4), r.choice(pii.KINDS)))
    scores = [r.uniform(-2, 2) for _ in spans]
    sets = []
    for n in range(len(spans) + 1):
        for c in itertools.combinations(range(len(spans)), n):
            ordered = sorted(spans[i][:2] for i in c)
            if all(a[1] <= b[0] for a, b in itertools.pairwise(ordered)):
                sets.append((sum(scores[i] for i in c), c))
    z = sum(math.exp(v) for v, _ in sets)
    want = [sum(math.exp(v) for v, c in sets if i in c) / z for i in range(len(spans))]
    assert pii._marginals(spans, scores) == pytest.approx(want, abs=1e-9)


def test_redaction_keeps_the_rest(model):
    text = "Regards,\nMaria K. Oldenfeld\n12 Birchmoor Lane\ntel: +1 415 555 0134 Version 3.2.1 is out. cc: m.oldenfeld [at] example [dot] org"
    spans = pii.decode(text, model)
    assert pii.redact(text, spans) == "Regards,\n[NAME]\n[ADDRESS]\ntel: [PHONE] Version 3.2.1 is out. cc: [EMAIL]"
    assert pii.redact("plain", []) == "plain"


@pytest.mark.parametrize("text", ["", " \n ", "The Amber Otter group kept build 1.14.2.", "Install queue-tools@1.14.2 first.", "The selector user@* matches nothing.", "Node 337488327874321098 sits 4 levels down.", "Path segments like 10 Main Menu or 3 Side Street Map are only titles.", "from 203.0.113.12 in 40 ms"])
def test_nothing_personal(text, model):
    assert found(text, model) == []


def test_table(spark, model):
    rows = [(1, "Reported by Nora Wendel <nora.wendel@example.com>. Reported by Nora Wendel <nora.wendel@example.com>.", "k"), (2, None, "k"), (3, "", "k"), (4, "word " * 50_000 + "call 415-555-0134 today", "k"), (1, "Reported by Nora Wendel <nora.wendel@example.com>.", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = sorted(map(tuple, pii.find_personal(df, fitted=model).collect()))
    assert got == [(1, "email", "nora.wendel@example.com"), (1, "name", "Nora Wendel"), (4, "phone", "415-555-0134")]
    red = {(r.doc_id, r.n_found): r.redacted for r in pii.redact_documents(df, fitted=model).collect()}
    assert red[2, 0] is None and red[3, 0] == "" and red[1, 2] == "Reported by [NAME] <[EMAIL]>."
    assert pii.find_personal(df.where("false"), fitted=model).count() == 0
