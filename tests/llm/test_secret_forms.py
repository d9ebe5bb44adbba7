"""Forms of assignment whose literal must be found and masked, and forms that must be left alone."""

import time

import pytest

from strandspark.llm import secret_scan

VALUE = "Qz7Lm2Xw9TbV"
FORMS = [
    'credential: str = "{}"', 'const credential: string = "{}";', 'let credential: &str = "{}";', "let credential: &'static str = \"{}\";", 'credential: Optional[str] = "{}"', 'credential: string | null = "{}"',
    'def connect(credential: str = "{}", port: int = 3):', 'credential ||= "{}"', 'credential ??= "{}"', 'credential = cond ? "{}" : "a"', 'credential = mode == "x" && f(y) ? "a" : "{}";', 'credential = "{}" if prod else "a"',
    'credential = "a" if prod else "{}"', '#define CREDENTIAL "{}"', '<add key="credential" value="{}"/>', '{{"name": "credential", "value": "{}"}}', "credential: {} more=x", "SHORT ?= {}\ncredential = SHORT", 'x = test ? "{}" : "b"\ncredential = x',
]


@pytest.mark.parametrize("form", FORMS)
def test_found_and_masked(form):
    text = f"before\n{form.format(VALUE)}\nafter"
    spans = [text[a:b] for a, b, _ in secret_scan.lex(text)]
    assert VALUE in spans and set(spans) <= {VALUE, "a", "b"}
    assert VALUE not in secret_scan.redact_text(text)


@pytest.mark.parametrize(
    "text",
    [
        f"# define credential = {VALUE}",
        f'credential ?? "{VALUE}"',
        "credential = x ? y : z",
        f'<add key="colour" value="{VALUE}"/>',
        f'colour: str = "{VALUE}"',
        f'credential == "{VALUE}"',
    ],
)
def test_left_alone(text):
    assert secret_scan.lex(text) == []


@pytest.mark.parametrize("unit", ["a=", "a?", 'a="' + "b" * 60 + '"', "a: b | c ", "a = b if c ", 'key="a" value="b" ', "#define a b\n", "a:A<", "a=? "])
def test_linear_in_the_text(unit):
    def seconds(n):
        began = time.process_time()
        secret_scan.lex(unit * (n // len(unit)))
        return time.process_time() - began

    seconds(10_000)
    assert seconds(400_000) < 12 * seconds(100_000) + 0.5
