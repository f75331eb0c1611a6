"""Links by channel of a few small files: bounds, nearest owners, comments and links with itself."""

import pytest

from glyphmill.operators import symbols, synthesis

WIRED = """class Store {
  start() {
    bus.on('ready', this.done);
    bus.once("late", function later(x) { run(x); });
    // bus.on('ready', ghost);
  }
  done() { this.emitter.emit('ready'); }
}
function fire() { const go = () => { bus.emit('ready'); bus.emit('late'); }; go(); }
function later() { return 1; }
"""
VIEW = """class App extends ui.Base {
  render() { return <Menu a={1}><Item/><App/></Menu>; }
  set() { if (true) { this.setState({ a: 1 }); } }
  plain() { return 1; }
}
function Menu() { return null; }
function Item() { return null; }
class Base { render() { return 0; } plain() { return 2; } other() { return 3; } }
"""


@pytest.fixture(scope="module")
def found(spark):
    crowd = "".join(f"function h{i}() {{ return 1; }}\nbus.on('busy', h{i});\n" for i in range(synthesis.EVENT_FANOUT + 1)) + "function one() { bus.emit('busy'); }\n"
    many = "function Big() { return [" + ", ".join(f"<T{i:02d}/>" for i in range(synthesis.JSX_CHILDREN + 5)) + "]; }\n" + "".join(f"function T{i:02d}() {{ return 1; }}\n" for i in range(synthesis.JSX_CHILDREN + 5))
    files = spark.createDataFrame([("w.js", "javascript", WIRED), ("v.js", "javascript", VIEW), ("c.js", "javascript", crowd), ("m.js", "javascript", many), ("n.js", "javascript", None)], "path string, language string, content string")
    own = symbols.symbols(files, ("javascript",))[0]
    return [tuple(r) for r in synthesis.synthesised(own, files, ("javascript",)).collect()]


def test_events(found):
    got = {(r[1], r[3], r[5], r[6]) for r in found if r[4] == "event-emitter"}
    assert got == {("go", "done", "ready", "w.js:3"), ("go", "later", "late", "w.js:4")}  # done calls on its own event; busy has too many handlers


def test_tags_state_and_bases(found):
    assert {(r[1], r[3]) for r in found if r[4] == "jsx-render" and r[0] == "v.js"} == {("render", "Menu"), ("render", "Item"), ("render", "App")}
    assert sorted(r[3] for r in found if r[1] == "Big") == [f"T{i:02d}" for i in range(synthesis.JSX_CHILDREN)]
    assert {(r[1], r[3], r[6]) for r in found if r[4] == "react-render"} == {("set", "render", "v.js:2")}
    assert {(r[1], r[3], r[5]) for r in found if r[4] == "interface-impl"} == {("Base.render", "App.render", "render"), ("Base.plain", "App.plain", "plain")}
