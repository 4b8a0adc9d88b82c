import random
import re

import pytest

from pagequire.llm.license_scan import PHRASES, TEMPLATES, compile_template, scan_licenses


def expand(markup):
    """The regular expression of a template over words joined by single spaces."""
    out = ""
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup):
        out += {"[[": "(?:", "]]": ")?"}.get(token) or (rf"(?:\S+ ){{0,{token[2:-2]}}}" if token[0] == "{" else re.escape(token) + " ")
    return re.compile(out)


def test_automata_accept_what_expressions_do():
    r = random.Random(2)
    templates = [("t", "a [[b c]] d {{2}} e"), ("t", "[[x {{3}} y]] a b"), ("t", "a {{1}} a [[a]] b"), ("t", "[[a [[b]] c]] d")]
    for label, markup in templates:
        automaton, pattern = compile_template(label, markup), expand(markup)
        for _ in range(400):
            words = [r.choice("abcdexy") for _ in range(r.randrange(9))]
            end, share = automaton.match([w.encode() for w in words], 0)
            text = "".join(w + " " for w in words)
            ends = [k for k in range(len(words) + 1) if pattern.fullmatch(text[: 2 * k])]
            assert end == max(ends, default=-1) and (share == 1.0) == (end >= 0)


def test_bad_templates():
    for markup in ("[[a", "[[a b]]", "{{3}}"):
        with pytest.raises(ValueError):
            compile_template("x", markup)


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    starts = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in starts]
    return len(words), len(starts), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in starts}))


def test_base_counts_and_labels(spark, table):
    texts = ["Released under the MIT License.", "no Apache-license; APACHE LICENSE éa", "Licensed under CC BY-NC 4.0.", None, "", "mit mit license mit license", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0. (the License)", "the permit license", "license " * 30000 + "mit license"]
    docs = table(list(enumerate(texts)))
    out = {r.doc_id: r for r in scan_licenses(docs).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert [out[i].labels for i in (0, 2, 3, 6, 7, 8)] == ["mit,mit-notice", "cc-by-nc-4.0", "", "gpl,gpl-3.0", "apache,apache-2.0", ""]
    assert out[0].score == out[2].score == 1.0 and out[3].score == 0.0
    assert (out[2].spans[0].first, out[2].spans[0].past) == (0, 7)
    assert scan_licenses(docs.limit(0)).count() == 0


def test_every_template_accepts_its_own_wording(spark, table):
    plain = [re.sub(r"\[\[|\]\]|\{\{\d+\}\}", " ", m) for _, m in TEMPLATES]
    out = {r.doc_id: r.labels.split(",") for r in scan_licenses(table([(i, f"Start. {t.upper()}; end") for i, t in enumerate(plain)])).collect()}
    assert all(label in out[i] for i, (label, _) in enumerate(TEMPLATES))


@pytest.mark.parametrize("seed", range(3))
def test_scans_of_whole_texts_equal_plain_expressions(spark, table, seed):
    """From left to right the longest run that the expression accepts, none over another; with base phrases between."""
    r = random.Random(seed)
    templates = [("t1", "ax [[bx cx]] dxx {{2}} ex"), ("t2", "ax bx"), ("t3", "cx [[{{1}} ax]] ax"), ("t4", "[[dxx]] ex ex")]
    texts = ["".join(r.choice(["ax", "bx", "cx", "dxx", "ex", "mit", "license", "LICENSE"]) + r.choice([" ", "\n", ", "]) for _ in range(r.randrange(60))) for _ in range(60)]
    out = {x.doc_id: x for x in scan_licenses(table(list(enumerate(texts))), templates=templates).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[a-z]+", text.lower())
        want = []
        for label, markup in templates:
            pattern, at = expand(markup), 0
            while at < len(words):
                ends = [k for k in range(at + 1, len(words) + 1) if pattern.fullmatch("".join(w + " " for w in words[at:k]))]
                if ends:
                    want.append((label, at, max(ends)))
                at = max(ends) if ends else at + 1
        assert sorted((s.label, s.first, s["past"]) for s in out[i].spans) == sorted(want)
        assert out[i].score == 1.0 if want else out[i].score < 1.0


def test_repeated_rows_and_null_ids(spark, table):
    rows = scan_licenses(table([(1, "mit license"), (1, "mit license"), (None, "mit license"), (2, "none")])).collect()
    assert sorted((str(x.doc_id), x.labels) for x in rows) == [("1", "mit"), ("1", "mit"), ("2", ""), ("None", "mit")]
