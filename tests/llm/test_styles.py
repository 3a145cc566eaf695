"""Style rules of pages: the right ones apply, in time that follows the page."""

import math
import random
import time

import pytest

from ripplework.llm import html_text


def test_rules_equal_a_plain_cascade():
    rng = random.Random(8)
    names = [".a", ".b", ".c", ".d", "#x", "#y"]
    for _ in range(300):
        rules = [(rng.choice(("", "p", "div", "*")), frozenset(rng.sample(names, rng.randrange(4))), rng.choice(("display:none", "display:block", "display:none!important", "visibility:hidden", "visibility:visible"))) for _ in range(rng.randrange(12))]
        rules = [(t, n, d) for t, n, d in rules if t or n]
        sheet = "\n".join(f"{t}{''.join(n)}{{{d}}}" for t, n, d in rules)
        styles = html_text.Styles([sheet])
        for tag in ("p", "div", "b"):
            own = set(rng.sample(names, rng.randrange(5))) - ({"#y"} if rng.random() < 0.9 else set())
            ids = [x for x in own if x[0] == "#"][:1]
            own = {x for x in own if x[0] == "."} | set(ids)
            named = {"class": " ".join(x[1:] for x in own if x[0] == ".")} | ({"id": ids[0][1:]} if ids else {})
            best = {}
            for i, (t, n, d) in enumerate(rules):
                if t in ("", "*", tag) and n <= own:
                    what, _, value = d.partition(":")
                    key = (value.endswith("!important"), sum(x[0] == "#" for x in n), sum(x[0] == "." for x in n), t not in ("", "*"), i)
                    best[what] = max(best.get(what, ((False,), "")), (key, value.removesuffix("!important")))
            seen = best.get("visibility", (0, None))[1]
            assert styles.of(tag, named) == (best.get("display", (0, ""))[1] == "none", None if seen is None else seen == "visible"), (sheet, tag, own)


@pytest.mark.parametrize("form", ["shared", "pairs", "wide"])
def test_many_rules_and_elements(form):
    n = 16_000
    if form == "shared":
        rule, element = (lambda i: f".a{i}.z"), (lambda i: f"z a{i}")
    elif form == "pairs":
        rule, element = (lambda i: f".a{i % 127}.b{i // 127}"), (lambda i: f"a{i % 127} b{i // 127}")
    else:
        rule, element = (lambda i: f".a{i}.z.y"), (lambda i: f"z y a{i} c{i} d{i} e{i}")
    page = "<style>" + "\n".join(rule(i) + "{display:none}" for i in range(0, n, 2)) + "</style>" + "".join(f'<p class="{element(i)}">t{i}</p>' for i in range(n))
    begin = time.process_time()
    got = html_text.render(page)
    assert got.split() == [f"t{i}" for i in range(1, n, 2)]
    assert time.process_time() - begin < 8


def test_layout_without_bounds():
    deep = "<ul><li>" * 50 + "x"
    wide = "<table><tr><td>" + "a" * 100 + "<td>b<tr><td>c<td>d</table>"
    free = html_text.Layout(math.inf, math.inf, math.inf, math.inf)
    assert len(html_text.render(deep, free).split("\n")[-1]) > len(html_text.render(deep).split("\n")[-1])
    assert html_text.render(wide, free).split("\n")[1] == "c" + " " * 101 + "d" and html_text.render(wide).split("\n")[1] == "c" + " " * 81 + "d"
