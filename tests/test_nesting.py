"""Nested chunks of three languages, and what no chunk may lose."""

import random

import pytest

from trawl.operators import nesting

PYTHON = '''import os

class Store:
    """A store.

    def not_a_method(self): this is a string
    """

    def put(self, key, value):
        self.rows[key] = value  # def nor_this():
        return key

    def get(self, key,
            default=None):
        def inner():
            return self.rows
        return inner().get(key, default)

def main():
    print("class Fake:")
'''
SCRIPT = """import x from 'y';
/* function old() {
} */
export class Store {
  put(key, value) {
    const f = `function inner() {`;
    return this.rows[key] = value; // }
  }
  async get(key) {
    return this.rows[key];
  }
}
export function main() {
  return "class Fake {";
}
"""
RUST = """use std::io;
pub struct Store {
    rows: Vec<u8>,
}
impl Store {
    pub fn put(&mut self, key: u8) {
        self.rows.push(key);
    }
    fn get(&self) -> u8 { self.rows[0] }
}
fn main() {
    println!("fn fake() {{");
}
"""


@pytest.mark.parametrize(
    "text,lang,want",
    [
        (PYTHON, "python", [("class Store:", 0), ("    def put(self, key, value):", 4), ("    def get(self, key,", 4), ("        def inner():", 8), ("def main():", 0)]),
        (SCRIPT, "javascript", [("export class Store {", 0), ("  put(key, value) {", 1), ("  async get(key) {", 1), ("export function main() {", 0)]),
        (RUST, "rust", [("pub struct Store {", 0), ("impl Store {", 0), ("    pub fn put(&mut self, key: u8) {", 1), ("    fn get(&self) -> u8 { self.rows[0] }", 1), ("fn main() {", 0)]),
    ],
)
def test_declarations(text, lang, want):
    assert [(text[s:].split("\n")[0], d) for s, d in nesting.declarations(text, lang)] == want


@pytest.mark.parametrize("text,lang", [(PYTHON, "python"), (SCRIPT, "typescript"), (RUST, "rust")])
@pytest.mark.parametrize("cap", [40, 120, 250, 10_000])
def test_slices_cover_the_text_and_keep_to_the_cap(text, lang, cap):
    got = nesting.nested_chunks(text, lang, cap)
    at = 0
    for chunk, a, z, _ in got:
        assert text[at:a].strip() == "" and text[a:z].strip() == chunk
        at = z
        assert z - a <= cap or "\n" not in text[a:z].rstrip("\n")
    assert text[at:].strip() == ""
    assert len(got) == 1 or cap < len(text)


def test_a_slice_over_the_cap_recurses_into_its_children():
    got = nesting.nested_chunks(PYTHON, "python", 150)
    heads = [(c.split("\n")[0], level) for c, *_, level in got]
    assert heads == [("import os", 1), ("class Store:", 2), ("def put(self, key, value):", 2), ("def get(self, key,", 2), ("def main():", 1)]


def test_odd_texts():
    assert nesting.nested_chunks("", "python") == [] and nesting.nested_chunks(" \n\n", None) == []
    assert [c for c, *_ in nesting.nested_chunks("a" * 30 + "\nb\nc", None, 5)] == ["a" * 30, "b\nc"]
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(["def f():\n", "class A:\n", "    ", "'", '"', '"""', "#", "{", "}", "(", "\n", "x = 1\n", "/*", "*/", "`", "é"]) for _ in range(60))
        for lang in ("python", "javascript", "go", None):
            got = nesting.nested_chunks(text, lang, 25)
            assert "".join("".join(text[a:z].split()) for _, a, z, _ in got) == "".join(text.split())


def test_as_rows(spark):
    df = spark.createDataFrame([(1, PYTHON, "a/b.py"), (2, None, "c.py"), (3, "plain\ntext", "d.unknown")], "id long, text string, path string")
    got = nesting.by_nesting(df, "id", "text", "path", 150).orderBy("id", "chunk_index").collect()
    assert [r.id for r in got] == [1] * 5 + [3] and got[1].level == 2
