"""What each front end reads of a small file."""

import pytest

from codeloom.frontends import extract
from codeloom.schema import ENTITY

KIND = {v: k for k, v in ENTITY.items()}


def read(lang, text):
    rows, symbols, error = extract(lang, text)
    out = {}
    for r in rows:
        out.setdefault(KIND[r["kind"]], []).append(r)
        raw = text.encode()
        assert 0 <= r["start_byte"] < r["end_byte"] <= len(raw), r
        assert raw[: r["start_byte"]].count(b"\n") + 1 == r["start_line"]
    return out, symbols, error


def names(rows):
    return [r["name"] for r in rows or []]


def test_typescript():
    text = """import React, { useState as use, type Props } from './react';
import type { T } from "types";
import './side';
export * from './all';
const fs = require('fs');

@Controller('/users')
export class Users extends Base<User> implements IUsers, Closeable {
  private repo: Repo = new Repo();
  constructor(private readonly db: Db) { super(); }
  @Get('/:id')
  async find(id: string, { limit, offset }: Page = {}): Promise<User> {
    if (id === `a ${id} {`) { throw new NotFound(id); }
    const { a, b } = await this.repo.load(id);
    try { return a?.b(/x[/]{/g) ? a : b; } catch (e) { return null; }
  }
  get size(): number { return this.items.map((x) => x.n).length; }
}
export interface IUsers extends Named { find(id: string): Promise<User>; size: number; }
export const total = async (xs: number[]) => xs.reduce((s, x) => s + x, 0);
function plain(n) { for (const x of n) { total(x); } }
router.get('/users/:id', auth, show);
"""
    got, symbols, error = read("typescript", text)
    assert error is None
    assert names(got["import"]) == ["'./react'", '"types"', "'./side'", "'./all'", "'fs'"]
    assert got["import"][0]["owner_type"] == "React,use,Props" and got["import"][1]["body_shape"] == "type_only"
    assert names(got["class"]) == ["Users"] and names(got["interface"]) == ["IUsers"]
    assert [(r["enclosing_function"], r["name"]) for r in got["extends"]] == [("Users", "Base"), ("IUsers", "Named")]
    assert names(got["implements"]) == ["IUsers", "Closeable"]
    fns = {r["name"]: r for r in got["function"]}
    assert set(fns) == {"constructor", "find", "size", "total", "plain"}
    assert fns["total"]["is_async"] and not fns["plain"]["is_async"] and fns["plain"]["owner_type"] is None
    assert [(r["name"], r["method"], r["path"], r["enclosing_function"]) for r in got["decorator"]] == [("Controller", None, None, "Users"), ("Get", "GET", "/:id", "find")]
    assert {"id", "limit", "offset", "db", "xs", "n"} <= set(names(got["parameter"]))
    assert {"a", "b", "fs"} <= set(names(got["variable"]))
    assert {"this.repo.load", "xs.reduce", "total", "NotFound", "this.items.map", "router.get"} <= set(names(got["call"]))
    assert len(got["callable_boundary"]) == 2 and [r["name"] for r in got["throw"]] == ["NotFound"]
    assert [(r["name"], r["method"], r["path"]) for r in got["route"]] == [("show", "GET", "/users/:id")]
    assert {r["enclosing_function"] for r in got["control_flow"]} == {"find", "size", "plain"}
    assert {s["name"] for s in symbols if s["kind"] == 0} == {"React", "use", "Props", "T"}


def test_go():
    text = """package main

import (
	"fmt"
	u "example.org/x/util"
)

type Store struct {
	Base
	*Other
	name string
}

type Reader interface {
	Closer
	Read(p []byte) (int, error)
}

func (s *Store) Get(id int, names ...string) (string, error) {
	x, err := s.load(id)
	if err != nil { return "", fmt.Errorf("bad %d {", id) }
	go func() { u.Log(`raw "`) }()
	return x, nil
}

func Map[T any](xs []T) []T { for _, x := range xs { use(x) }; return xs }
"""
    got, _, error = read("go", text)
    assert error is None
    assert [(r["name"], r["owner_type"]) for r in got["import"]] == [("fmt", "fmt"), ("example.org/x/util", "u")]
    assert names(got["class"]) == ["Store"] and names(got["interface"]) == ["Reader"]
    assert [(r["enclosing_function"], r["name"]) for r in got["extends"]] == [("Store", "Base"), ("Store", "Other"), ("Reader", "Closer")]
    assert [(r["name"], r["owner_type"]) for r in got["function"]] == [("Read", "Reader"), ("Get", "Store"), ("Map", None)]
    assert {"id", "names", "xs"} <= set(names(got["parameter"])) and {"x", "err"} <= set(names(got["variable"]))
    assert {"s.load", "fmt.Errorf", "u.Log", "use"} <= set(names(got["call"])) and len(got["callable_boundary"]) == 1


def test_java():
    text = """package a.b;
import java.util.List;
import static a.C.*;

@RestController
public class Job extends Base<Job> implements Runnable, java.io.Closeable {
  private final List<String> names = new ArrayList<>();
  public Job(Repo repo) throws IOException { super(repo); }
  @GetMapping("/jobs")
  @Override public <T> List<T> all(Map<String, T> by, int n) throws A, B {
    for (String s : names) { if (s.isEmpty()) { repo.find(s).get(); } }
    Runnable r = () -> log("x");
    return n > 0 ? null : List.of();
  }
  abstract void none();
  enum Kind { A, B }
}
interface Shape { double area(); }
record Point(int x, int y) {}
"""
    got, _, error = read("java", text)
    assert error is None
    assert names(got["import"]) == ["java.util.List", "a.C"]
    assert names(got["class"]) == ["Job", "Kind", "Point"] and names(got["interface"]) == ["Shape"]
    assert names(got["extends"]) == ["Base"] and names(got["implements"]) == ["Runnable", "java.io.Closeable"]
    assert [(r["name"], r["owner_type"]) for r in got["function"]] == [("Job", "Job"), ("all", "Job"), ("none", "Job"), ("area", "Shape")]
    assert [(r["name"], r["method"], r["path"], r["enclosing_function"]) for r in got["decorator"]][:2] == [("RestController", None, None, "Job"), ("GetMapping", "GET", "/jobs", "all")]
    assert {"repo", "by", "n", "x", "y"} <= set(names(got["parameter"])) and "names" in names(got["variable"])
    assert {"s.isEmpty", "List.of", "log"} <= set(names(got["call"]))


def test_rust():
    text = """use std::{fmt, io::{self, Read as R}};
use crate::a::b;
mod inner;

pub struct Job<'a> { name: &'a str }
pub trait Run: Send + Named { fn run(&self) -> u8; }
impl<'a> Run for Job<'a> {
    fn run(&self) -> u8 { if self.ok() { return 1; } b'}' }
}
impl Job<'_> {
    pub async fn load<T: Read>(&mut self, path: &str, n: usize) -> io::Result<()> where T: Send {
        let mut x = r#"raw " { "#;
        println!("{}", x);
        match n { 0 => Ok(()), _ => Self::other(path)?.go() }
    }
}
#[tokio::test]
async fn works() { assert_eq!(1, 1); }
"""
    got, _, error = read("rust", text)
    assert error is None
    assert [(r["name"], r["owner_type"]) for r in got["import"]] == [("std::fmt", "fmt"), ("std::io", "io"), ("std::io::Read", "R"), ("crate::a::b", "b"), ("inner", "inner")]
    assert names(got["class"]) == ["Job"] and names(got["interface"]) == ["Run"]
    assert names(got["extends"]) == ["Send", "Named"] and [(r["name"], r["enclosing_function"]) for r in got["implements"]] == [("Run", "Job")]
    fns = [(r["name"], r["owner_type"], r["is_async"], r["is_test"]) for r in got["function"]]
    assert fns == [("run", "Run", False, False), ("run", "Job", False, False), ("load", "Job", True, False), ("works", None, True, True)]
    assert {"path", "n"} <= set(names(got["parameter"])) and "x" in names(got["variable"])
    assert {"self.ok", "println!", "Self::other", "assert_eq!"} <= set(names(got["call"]))


def test_csharp():
    text = """using System.Text;
using J = Newtonsoft.Json;
namespace A.B {
  [ApiController]
  public class Users : ControllerBase, IUsers {
    private readonly IRepo _repo;
    public Users(IRepo repo) : base(repo) { _repo = repo; }
    [HttpGet("all")]
    public async Task<List<User>> All(int page = 1, string? name = null) {
      foreach (var u in await _repo.Load(page)) { if (u == null) continue; }
      return items.Where(x => x.Ok).ToList();
    }
    public int Size => items.Count();
    public int Twice(int n) => n * 2;
  }
  public interface IUsers : INamed { int Count(string q); }
}
"""
    got, _, error = read("csharp", text)
    assert error is None
    assert [(r["name"], r["owner_type"]) for r in got["import"]] == [("System.Text", "Text"), ("Newtonsoft.Json", "J")]
    assert names(got["class"]) == ["Users"] and names(got["interface"]) == ["IUsers"]
    assert [(KIND[r["kind"]], r["name"]) for k in ("extends", "implements") for r in got[k]] == [("extends", "ControllerBase"), ("extends", "INamed"), ("implements", "IUsers")]
    assert [(r["name"], r["is_async"]) for r in got["function"]] == [("Users", False), ("All", True), ("Twice", False), ("Count", False)]
    assert [(r["name"], r["method"], r["path"]) for r in got["decorator"]] == [("ApiController", None, None), ("HttpGet", "GET", "all")]
    assert {"repo", "page", "name", "n", "q"} <= set(names(got["parameter"]))


@pytest.mark.parametrize(
    ("lang", "text", "types", "functions", "imports", "supers"),
    [
        ("kotlin", "import a.b.C\nclass A(val x: Int) : Base(x), Named {\n  suspend fun go(n: Int): Int { return n }\n  fun one() = 1\n}\ninterface Named { fun name(): String }\nfun String.twice(): String = this + this\n", ["A", "Named"], ["go", "one", "name", "twice"], ["a.b.C"], ["Base", "Named"]),
        ("swift", "import UIKit\nclass A: Base, Named {\n  init(x: Int) { super.init() }\n  func go(to place: String) async -> Int { guard let y = z else { return 0 }; return y }\n}\nprotocol Named { func name() -> String }\nextension A { func more() {} }\n", ["A", "Named"], ["init", "go", "name", "more"], ["UIKit"], ["Base", "Named"]),
        ("php", "<?php\nuse App\\Models\\User as U;\nclass A extends Base implements Named {\n  public function go(int $n, $m = 1): int { if ($n) { return $this->run($n); } }\n}\nfunction top($x) { return 1; }\n", ["A"], ["go", "top"], ["App\\Models\\User"], ["Base", "Named"]),
        ("cpp", '#include <vector>\n#include "a/b.h"\nclass A : public Base {\n public:\n  A(int n) : n_(n) {}\n  int go(const std::string& s) const { return s.size(); }\n  virtual void none() = 0;\n};\nint A::other(int x) { return x; }\nstatic int top(char *p) { return *p; }\n', ["A"], ["A", "go", "none", "other", "top"], ["vector", "a/b.h"], ["Base"]),
        ("c", '#include <stdio.h>\nstruct point { int x; };\nstatic int add(int a, int b) { return a + b; }\nint main(void) { printf("%d", add(1, 2)); return 0; }\n', ["point"], ["add", "main"], ["stdio.h"], []),
        ("scala", "import a.b.{C, D}\nclass A(x: Int) extends Base with Named {\n  def go(n: Int): Int = { n + 1 }\n  def one = 1\n}\ntrait Named { def name: String }\n", ["A", "Named"], ["go", "one", "name"], ["a.b.C", "a.b.D"], ["Base", "Named"]),
        ("dart", "import 'package:a/b.dart';\nclass A extends Base implements Named {\n  A(this.x);\n  Future<int> go(int n) async { return n; }\n}\nvoid main() { go(1); }\n", ["A"], ["go", "main"], ["package:a/b.dart"], ["Base", "Named"]),
        ("solidity", 'import "./b.sol";\ncontract A is Base, Named {\n  constructor(uint n) { x = n; }\n  function go(uint256 n) public view returns (uint256) { require(n > 0); return n; }\n}\n', ["A"], ["constructor", "go"], ["./b.sol"], ["Base", "Named"]),
        ("javascript", "import a from './a.js';\nclass A extends B { go(x) { return x; } static make() { return new A(); } }\nconst f = function (n) { return n; };\nasync function* gen() { yield 1; }\n", ["A"], ["go", "make", "f", "gen"], ["'./a.js'"], ["B"]),
    ],
)
def test_other_languages(lang, text, types, functions, imports, supers):
    got, _, error = read(lang, text)
    assert error is None
    assert names(got.get("class", []) + got.get("interface", [])) == types or sorted(names(got.get("class", []) + got.get("interface", []))) == sorted(types)
    assert names(got.get("function")) == functions
    assert names(got.get("import")) == imports
    assert names(got.get("extends", []) + got.get("implements", [])) == supers


def test_rows_before_an_error_are_kept():
    got, _, error = read("typescript", "class A { go() { return 1; } }\nfunction b( { {\n")
    assert error and names(got["class"]) == ["A"] and names(got["function"])[0] == "go"
    got, _, error = read("python", "def a():\n    return 1\n\ndef broken(:\n")
    assert error and "a" in names(got["function"])


def test_texts_that_are_no_code():
    for lang in ("typescript", "go", "java", "rust", "csharp", "kotlin", "swift", "php", "cpp", "scala", "dart", "solidity", "c"):
        for text in ("", "}", "((((", "'", '"', "`", "/*", "é" * 50, "class", "func", "fn (", "import", "use a::{b", "type X", "@", "a.b.c(", "= > < =>", "impl for {", "\x00"):
            extract(lang, text)
