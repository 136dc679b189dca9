from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import pii


def luhn(s: str) -> bool:
    digits = [int(c) for c in s[::-1]]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def brute(t: str) -> dict[str, list[tuple[int, int]]]:
    out = {k: [] for k in pii.KINDS}
    out["email"] = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern in (("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            d = re.sub(r"[^0-9]", "", m[0])
            if (13 <= len(d) <= 19 and luhn(d)) if kind == "card" else 9 <= len(d) <= 15:
                out[kind].append(m.span())
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ09.@+-_ ()%\n1é5", max_size=60))
def test_plain_matches_equal_the_patterns(t):
    assert pii.identifiers(t) == brute(t)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("mail john(at)example(dot)co(dot)uk!", "email", "john(at)example(dot)co(dot)uk"),
        ("write jane at example dot org today", "email", "jane at example dot org"),
        ("mail jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("mail j​ohn＠example．com", "email", "j​ohn＠example．com"),
        ("host 192 dot 168 dot 0 dot 1 up", "ip", "192 dot 168 dot 0 dot 1"),
        ("host １９２．１６８．０．１ up", "ip", "１９２．１６８．０．１"),
        ("call plus four nine one five one two three four five six seven", "phone", "plus four nine one five one two three four five six seven"),
        ("call plus 1 seven four three 555 three eight two four", "phone", "plus 1 seven four three 555 three eight two four"),
        ("host one nine two dot one six eight dot 0 dot one up", "ip", "one nine two dot one six eight dot 0 dot one"),
        ("MAIL JOHN AT EXAMPLE DOT COM NOW", "email", "JOHN AT EXAMPLE DOT COM"),
        ("card four five three nine one four eight eight zero three four three six four six seven end", "card", "four five three nine one four eight eight zero three four three six four six seven"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, spans = pii.find(text)
    a, b = next(s for s in spans[kind] if s not in base[kind])
    assert text[a:b] == found


@pytest.mark.parametrize("text", ["Look at the house. He was at home dot.", "one two three, four", "un deux trois", "arroba y punto", "(at) [dot]", "meet at noon at the point of no return"])
def test_clean_texts_stay_clean(text):
    assert pii.joined(pii.find(text)[1]) == ""


def test_base_spans_stay_and_order():
    text = "b@c.de 10.0.0.1 and x [at] y [dot] zz"
    base, spans = pii.find(text)
    assert pii.joined(spans).startswith("email:0:6,email:20:37,ip:7:15")
    assert set(base["email"]) <= set(spans["email"])
    assert pii.redact(text) == "<email> <ip> and <email>"


def test_long_runs_are_linear():
    assert pii.identifiers("1" * 200_000)["ip"] == []
    assert pii.identifiers("a" * 200_000)["email"] == []
    assert pii.identifiers("a@" * 100_000)["email"] == []


def test_edges(edge, empty):
    out = {r.doc_id: r for r in pii.personal_data(edge).collect()}
    assert out[3].n_email == 0 and out[3].spans == ""
    assert pii.personal_data(empty).count() == 0
    assert pii.redacted(edge).columns == edge.columns
    assert pii.redacted(edge).where("text is null").count() == 1


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("card 4539\u00a01488\u00a00343\u00a06467 end", "card", "4539\u00a01488\u00a00343\u00a06467"),
        ("call +49\u00a0151\u00a02345\u00a06789 now", "phone", "+49\u00a0151\u00a02345\u00a06789"),
        ("mail jane@exampleſ.com", "email", "jane@exampleſ.com"),
        ("mail:john at example [dot] com now", "email", "john at example [dot] com"),
        ("mail:john at mail dot example(dot)co.uk now", "email", "john at mail dot example(dot)co.uk"),
        ("mail:john at example．com now", "email", "john at example．com"),
        ("mail:john dot doe at example dot com now", "email", "john dot doe at example dot com"),
        ("mail:john dot f dot doe at example [dot] com now", "email", "john dot f dot doe at example [dot] com"),
        ("mail:john dot doe [at] example [dot] com now", "email", "john dot doe [at] example [dot] com"),
        ("mail:john dot doe@example dot com now", "email", "john dot doe@example dot com"),
        ("mail:juan punto paz arroba ejemplo punto es", "email", "juan punto paz arroba ejemplo punto es"),
        ("card (four 539 1488 0343 6467)", "card", "four 539 1488 0343 6467"),
        ("host 192 POİNT 168 poınt 0 point 1 up", "ip", "192 POİNT 168 poınt 0 point 1"),
    ],
)
def test_disguises_in_combination(text, kind, found):
    base, spans = pii.find(text)
    assert [text[a:b] for a, b in spans[kind]] == [found]


@pytest.mark.parametrize("text", ["Look at example.com [dot]", "at this point look at example.com", "a\u00a0b dot c", "the dot at the end (.) stays", "dot dot dot"])
def test_halves_of_disguises_stay_clean(text):
    assert pii.joined(pii.find(text)[1]) == ""


def test_unusual_is_what_characters_rewrites():
    import sys

    every = [chr(i) for i in range(sys.maxunicode + 1)]
    assert [c for c in every if pii.unusual().search(c)] == [c for c in every if pii.characters(c)]


def hinted(text):
    plain, changing = pii.hints(pa.array([text]))
    return bool(plain[0]), bool(changing[0])


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["one", "three", "sıx", "5", "12", "plus", "at", "dot", "poınt", "[at]", "(dot)", "(.)", "x", "(", ")", '"', "\u00a0", "ſ", "ſix", "–", "’", "Ā", "é", "-", ".", "a.b", "@", "_", "\n", "\t", "&#46;", "&commat;", "。", "ät", "arroba", "punto", "un", "zéro", " ", " ", " "]), max_size=14))
def test_hints_miss_nothing(parts):
    text = "".join(parts)
    plain, changing = hinted(text)
    assert changing or pii.rewritten(text).text == text or not pii.disguised(text, pii.identifiers(text))
    assert plain or not any(pii.identifiers(text).values())


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aZ09.@+- \né", max_size=60))
def test_plain_hints_miss_nothing(text):
    assert hinted(text)[0] or not any(pii.identifiers(text).values())


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("john at example.com", "john at example.com"),
        ("mail:john_at_example_dot_com now", "john_at_example_dot_com"),
        ("mail:j.doe_at_example.com now", "j.doe_at_example.com"),
        ("mail john&#64;example&#46;com now", "john&#64;example&#46;com"),
        ("mail john&#x40;example&period;com now", "john&#x40;example&period;com"),
        ("mail john@example。com now", "john@example。com"),
        ("mail:john at example\ndot com now", "john at example\ndot com"),
        ("look at john at example dot com", "john at example dot com"),
        ("mail:john at\n example dot com dot", "john at\n example dot com"),
    ],
)
def test_more_disguises(text, found):
    base, spans = pii.find(text)
    assert [text[a:b] for a, b in spans["email"]] == [found]
    assert any(hinted(text))


def test_wider_spans_join_base_spans_and_nothing_leaks():
    text = "write to jоhn@example.com or 10.0.0.1"
    base, spans = pii.find(text)
    assert [text[a:b] for a, b in base["email"]] == ["hn@example.com"]
    assert [text[a:b] for a, b in spans["email"]] == ["jоhn@example.com", "hn@example.com"]
    assert pii.redact(text) == "write to <email> or <ip>"
    text = "john.doe@exаmple.com.au"
    assert pii.redact(text) == "<email>"


NAMES = ["john", "jane.doe", "k42", "a_b", "m.x-y", "Juan+Paz"]
HOSTS = ["example.com", "mail.example.org", "a-b.co.uk", "xn1.net"]
TWIN = {v: k for k, v in pii.LOOK_ALIKES.items()}


def twisted(rng, text):
    """text with some letters as look-alikes, wide forms or with an invisible character after them."""
    forms = [lambda c: TWIN.get(c, c), lambda c: chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c, lambda c: c + rng.choice(sorted(pii.INVISIBLE))]
    return "".join(rng.choice(forms)(c) if rng.random() < 0.3 else c for c in text[:-1]) + text[-1]


def spelled(rng, digits):
    names = {}
    for w, d in pii.SPELLED.items():
        names.setdefault(d, []).append(w)
    return " ".join(rng.choice(names[d][:1]) for d in digits)


def disguise(rng):
    """(kind, a disguised identifier)."""
    way = rng.randrange(7)
    if way < 4:
        name, host = rng.choice(NAMES), rng.choice(HOSTS)
        if way == 0:
            return "email", twisted(rng, f"{name}@{host}")
        if way == 1:
            at, dot = rng.choice([(" [at] ", "(dot)"), ("(at)", " [.] "), ("{@}", ".")])
            return "email", f"{name}{at}{host.replace('.', dot)}"
        if way == 2:
            gap = rng.choice([" ", "_", "\n"])
            at, dot = rng.choice([p for p in pii.PLAIN])
            return "email", gap.join([name, at, host.replace(".", f"{gap}{dot}{gap}")])
        return "email", f"{name}&#64;{host.replace('.', '&#46;')}"
    if way == 4:
        return "ip", rng.choice([" dot ", "．", "。"]).join(str(rng.randrange(256)) for _ in range(4))
    if way == 5:
        return "phone", "plus " + spelled(rng, "".join(rng.choice("0123456789") for _ in range(11)))
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    card = next(body + c for c in "0123456789" if luhn(body + c))
    return "card", rng.choice([lambda: spelled(rng, card), lambda: "".join(chr(0xFF10 + int(c)) for c in card), lambda: "\u00a0".join(card[k : k + 4] for k in range(0, 16, 4))])()


def test_random_disguises_come_back_with_their_spans():
    rng = random.Random(5)
    for _ in range(1500):
        kind, hidden = disguise(rng)
        before, after = rng.choice([("Kontakt: ", " – danke"), ("", ""), ("voilà (", ")"), ("siehe; ", ", und"), ("é\n\n\n", "\n\n\nwe")])
        text = before + hidden + after
        plain, changing = hinted(text)
        base, spans = pii.find(text)
        assert (len(before), len(before) + len(hidden)) in spans[kind], (kind, text, spans)
        assert plain or changing
        assert pii.redact(text) == f"{before}<{kind}>{after}"


def test_texts_without_hints_are_passed_as_they_are(spark, documents, texts):
    some = [t for t in texts.values() if not any(hinted(t))]
    assert some and all(pii.find(t)[1] == {k: [] for k in pii.KINDS} for t in some)
    got = {r.doc_id: r.text for r in pii.redacted(documents).collect()}
    assert got == {i: pii.redact(t) for i, t in texts.items()}


def test_long_addresses_are_linear():
    text = "a dot " * 20_000 + "b at c dot com"
    assert pii.find(text)[1]["email"] == [(0, len(text))]
