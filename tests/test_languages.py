import pytest

from nodeloom.sources.extractors import EXTRACTORS
from tests.test_sources import frame

CASES = {
    "a/web.ts": (
        "import { x } from './util/http';\nexport * from 'pkg';\n// class Not {}\nexport class Box<T> extends Base implements Shape, Thing {\n  open(n: number): void {\n    this.close();\n    helper(`class No {`);\n  }\n  private close() {}\n}\nexport const make = async (k) => { open(k); };\nfunction helper(s) { return s; }\nconst y = require('fs');\n",
        {"Box", ".open()", ".close()", "make()", "helper()"},
        {("a_web_box", "inherits", "base"), ("a_web_box", "implements", "shape"), ("a_web_box", "implements", "thing"), ("a_web", "imports_from", "util_http"), ("a_web", "re_exports", "pkg"), ("a_web", "imports", "fs"), ("a_web_box", "method", "a_web_box_open")},
        {("a_web_box_open", "close"), ("a_web_box_open", "helper"), ("a_web_make", "open")},
    ),
    "m/srv.go": (
        'package m\nimport (\n\t"fmt"\n\tx "net/http"\n)\ntype Server struct { n int }\nfunc New() *Server { return &Server{} }\nfunc (s *Server) Run(a int) error {\n\tfmt.Println("func No() {")\n\treturn s.stop()\n}\n',
        {"Server", "New()", ".Run()"},
        {("m_srv", "imports", "fmt"), ("m_srv", "imports", "net_http"), ("m_srv_server", "method", "m_srv_server_run"), ("m_srv", "contains", "m_srv_new")},
        {("m_srv_server_run", "Println"), ("m_srv_server_run", "stop")},
    ),
    "s/lib.rs": (
        "use std::io;\npub trait Draw: Base { fn draw(&self); }\npub struct Pen<'a> { s: &'a str }\nimpl<'a> Draw for Pen<'a> {\n    fn draw(&self) { line(1); }\n}\nfn line(n: u8) {}\n",
        {"Draw", "Pen", ".draw()", "line()"},
        {("s_lib_pen", "implements", "draw"), ("s_lib_draw", "inherits", "base"), ("s_lib", "imports", "std_io"), ("s_lib_pen", "method", "s_lib_pen_draw")},
        {("s_lib_pen_draw", "line")},
    ),
    "j/App.java": (
        "import java.util.List;\npublic class App extends Core implements Runnable {\n  private int n;\n  public App(int n) { this.n = n; }\n  @Override\n  public void run() { go(list.size()); }\n  static <T> T go(T x) throws Error { return x; }\n}\nrecord P(int a) implements Q { }\n",
        {"App", ".App()", ".run()", ".go()", "P"},
        {("j_app_app", "inherits", "core"), ("j_app_app", "implements", "runnable"), ("j_app_p", "implements", "q"), ("j_app", "imports", "java_util_list")},
        {("j_app_app_run", "go"), ("j_app_app_run", "size")},
    ),
    "c/a.c": ('#include <stdio.h>\n#include "b/own.h"\nstruct P { int x; };\nstatic int add(int a, int b) {\n  return a + b;\n}\nint main(void) { return add(1, printf("x {")); }\n', {"P", "add()", "main()"}, {("c_a", "imports", "stdio"), ("c_a", "imports", "b_own")}, {("c_a_main", "add"), ("c_a_main", "printf")}),
    "c/a.cpp": ("class A : public B {\n public:\n  void f();\n};\nvoid A::f() { g(); }\nvoid g() {}\n", {"A", ".f()", "g()"}, {("c_a_a", "inherits", "b")}, {("c_a_a_f", "g")}),
    "r/x.rb": ("require 'json'\nclass A < B::C\n  def go(x)\n    if x then help(x) end\n  end\n  def help(y)\n  end\nend\ndef top\n  1\nend\n", {"A", ".go()", ".help()", "top()"}, {("r_x_a", "inherits", "c"), ("r_x", "imports", "json")}, {("r_x_a_go", "help")}),
    "k/K.kt": ("import a.b.C\nclass K(val n: Int) : Base(n), Face {\n  fun go(): Int = other(1)\n}\nfun other(x: Int) = x\n", {"K", ".go()", "other()"}, {("k_k_k", "inherits", "base"), ("k_k_k", "inherits", "face"), ("k_k", "imports", "a_b_c")}, {("k_k_k_go", "other")}),
    "p/a.php": ("<?php\nuse App\\Core;\nclass A extends B implements C {\n  public function go($x) { return $this->run(help($x)); }\n}\nfunction help($x) {}\n", {"A", ".go()", "help()"}, {("p_a_a", "inherits", "b"), ("p_a_a", "implements", "c"), ("p_a", "imports", "app_core")}, {("p_a_a_go", "run"), ("p_a_a_go", "help")}),
    "w/s.swift": ("import UIKit\nclass A: B, P {\n  func go() { help() }\n}\nextension A: Q { func more() { go() } }\nfunc help() {}\n", {"A", ".go()", ".more()", "help()"}, {("w_s_a", "inherits", "b"), ("w_s_a", "implements", "q"), ("w_s", "imports", "uikit")}, {("w_s_a_go", "help"), ("w_s_a_more", "go")}),
    "n/x.cs": ("using System;\nnamespace N.M;\npublic class A : Base, IThing {\n  public int Go(int x) => Help(x);\n  int Help(int x) { return x; }\n}\n", {"N.M", "A", ".Go()", ".Help()"}, {("n_x_a", "inherits", "base"), ("n_x_a", "implements", "ithing"), ("n_x", "imports", "system")}, {("n_x_a_go", "Help")}),
    "e/a.ex": ("defmodule A.B do\n  alias X.Y\n  def go(x) do\n    help(x)\n  end\n  defp help(x), do: x\nend\n", {"A.B", ".go()", ".help()"}, {("e_a", "imports", "x_y")}, {("e_a_a_b_go", "help")}),
    "f/a.f90": ("module m\n  use other\ncontains\n  subroutine go(x)\n    call help(x)\n  end subroutine go\n  pure function help(x) result(y)\n  end function help\nend module m\n", {"m", ".go()", ".help()"}, {("f_a", "imports", "other"), ("f_a_m", "method", "f_a_m_help")}, {("f_a_m_go", "help")}),
    "l/a.lua": ("local j = require('json')\nlocal M = {}\nfunction M.go(x)\n  if x then help(x) end\nend\nlocal function help(y) return y end\n", {".go()", "help()"}, {("l_a", "imports", "json")}, {("l_a_m_go", "help")}),
    "d/a.dart": ("import 'package:x/y.dart';\nclass A extends B implements C {\n  void go(int n) { help(n); }\n}\nvoid help(int n) {}\n", {"A", ".go()", "help()"}, {("d_a_a", "inherits", "b"), ("d_a_a", "implements", "c"), ("d_a", "imports", "x_y")}, {("d_a_a_go", "help")}),
    "q/A.scala": ("import a.B\nclass A(n: Int) extends Base(n) with Face {\n  def go(x: Int): Int = help(x)\n}\nobject O { def help(x: Int) = x }\n", {"A", ".go()", "O", ".help()"}, {("q_a_a", "inherits", "base"), ("q_a_a", "inherits", "face"), ("q_a", "imports", "a_b")}, {("q_a_a_go", "help")}),
    "h/a.ps1": ("Import-Module Net\nfunction Get-It { param($x)\n  Set-It $x\n}\nfunction Set-It($y) { }\n", {"Get-It()", "Set-It()"}, {("h_a", "imports", "net")}, {("h_a_get_it", "Set-It")}),
    "v/a.sv": ("module top;\n  function automatic int go(int x);\n    return help(x);\n  endfunction\nendmodule\nclass A extends B;\nendclass\n", {"top", ".go()", "A"}, {("v_a_a", "inherits", "b")}, {("v_a_top_go", "help")}),
    "u/a.jl": ("module M\nusing Base, Other\nstruct P <: Q\n  x\nend\nfunction go(x)\n  help(x)\nend\nhelp(y) = y\nend\n", {"M", "P", ".go()", ".help()"}, {("u_a_m_p", "inherits", "q"), ("u_a", "imports", "base"), ("u_a", "imports", "other")}, {("u_a_m_go", "help")}),
    "o/a.m": ("#import <X/Y.h>\n@interface A : B <C>\n- (void)go;\n@end\n@implementation A\n- (void)go {\n  [self help];\n}\n@end\n", {"A", ".go()"}, {("o_a_a", "inherits", "b"), ("o_a_a", "implements", "c"), ("o_a", "imports", "x_y")}, {("o_a_a_go", "help")}),
    "b/a.pas": ("unit U;\ninterface\nuses SysUtils, Classes;\ntype\n  TA = class(TB)\n    procedure Go;\n  end;\nimplementation\nprocedure TA.Go;\nbegin\n  Help(1);\nend;\nprocedure Help(x: Integer);\nbegin\nend;\nend.\n", {"TA", ".Go()", "Help()"}, {("b_a_ta", "inherits", "tb"), ("b_a", "imports", "sysutils"), ("b_a", "imports", "classes")}, {("b_a_ta_go", "Help")}),
    "g/a.groovy": ("import x.Y\nclass A extends B {\n  def 'does it'() {\n    help()\n  }\n  void help() { }\n}\n", {"A", ".does it()", ".help()"}, {("g_a_a", "inherits", "b"), ("g_a", "imports", "x_y")}, {("g_a_a_does_it", "help")}),
    "y/a.dm": ('#include "z.dm"\n/obj/sword\n\tproc/hit(mob/m)\n\t\tm.hurt(1)\n/proc/run()\n\thelp()\n', {"/obj/sword", ".hit()", "run()"}, {("y_a", "imports", "z")}, {("y_a_obj_sword_hit", "hurt"), ("y_a_run", "help")}),
    "x/a.cls": ("public with sharing class A extends B {\n  public static void go() { help(); }\n  private void help() { }\n}\n", {"A", ".go()", ".help()"}, {("x_a_a", "inherits", "b")}, {("x_a_a_go", "help")}),
    "z/a.zig": ('const std = @import("std");\nconst P = struct {\n  pub fn go(self: P) void { help(); }\n};\nfn help() void {}\n', {"P", ".go()", "help()"}, {("z_a", "imports", "std")}, {("z_a_p_go", "help")}),
    "t/a.r": ("library(dplyr)\ngo <- function(x) {\n  help(x)\n}\nhelp <- function(y) y\n", {"go()", "help()"}, {("t_a", "imports", "dplyr")}, {("t_a_go", "help")}),
    "i/main.tf": ('variable "n" {}\nresource "aws_vpc" "v" {\n  count = var.n # local.no\n}\nlocals {\n  a = aws_vpc.v.id\n}\n', {"var.n", "aws_vpc.v", "local.a"}, {("i_aws_vpc_v", "references", "i_var_n"), ("i_local_a", "references", "i_aws_vpc_v")}, set()),
    "n/a.csproj": ('<Project xmlns="x"><ItemGroup><ProjectReference Include="..\\b\\B.csproj"/><PackageReference Include="Json" Version="1"/></ItemGroup><PropertyGroup><TargetFramework>net8.0</TargetFramework></PropertyGroup></Project>', {"Json", "net8.0"}, {("n_a", "imports", "b_b"), ("n_a", "imports", "nuget_json")}, set()),
    "n/a.sln": ('Project("{F}") = "A", "a\\A.csproj", "{1}"\n\tProjectSection(ProjectDependencies) = postProject\n\t\t{2} = {2}\n\tEndProjectSection\nEndProject\nProject("{F}") = "B", "b\\B.csproj", "{2}"\nEndProject\n', {"A", "B"}, {("n_a", "contains", "a_a"), ("a_a", "imports", "b_b")}, set()),
    "n/P.razor": ("@using A.B\n@inherits Base\n<Grid x=1 />\n@code {\n  void Go() { Help(); }\n}\n", {".Go()"}, {("n_p", "imports", "a_b"), ("n_p", "inherits", "base")}, {("n_p", "Grid"), ("n_p_code_go", "Help")}),
    "n/f.dfm": ("object F: TF\n  OnCreate = Start\n  object B: TButton\n    OnClick = Hit\n  end\nend\n", {"F", "B"}, {("n_f_f", "contains", "n_f_f_b"), ("n_f_f_b", "references", "tbutton")}, {("n_f_f", "Start"), ("n_f_f_b", "Hit")}),
    "n/a.svelte": ("<script lang=\"ts\">\nimport Row from './Row.svelte';\nfunction go() { help(); }\n</script>\n<Row on:click={go}/>\n", {"go()"}, {("n_a", "imports_from", "n_row")}, {("n_a_go", "help"), ("n_a", "Row")}),
    "n/a.psd1": ("@{ RootModule = 'A.psm1'\n  RequiredModules = @('B', @{ ModuleName = 'C'; ModuleVersion = '1.0' })\n}\n", set(), {("n_a", "imports", "a"), ("n_a", "imports", "b"), ("n_a", "imports", "c")}, set()),
    "n/a.lpk": ('<CONFIG><Package><Files><Item><Filename Value="u.pas"/></Item></Files><RequiredPkgs><Item><PackageName Value="LCL"/></Item></RequiredPkgs></Package></CONFIG>', {"LCL"}, {("n_a", "contains", "n_u"), ("n_a", "imports", "package_lcl")}, set()),
    "n/a.dmm": ('"a" = (/obj/table,/turf/floor)\n(1,1,1) = {"a"}\n', set(), {("n_a", "uses", "obj_table"), ("n_a", "uses", "turf_floor")}, set()),
    "n/a.dmf": ('window "w"\n\telem "e"\n', {"w", "e"}, {("n_a", "contains", "n_a_w"), ("n_a_w", "contains", "n_a_w_e")}, set()),
}


@pytest.mark.parametrize("path", CASES)
def test_language(path):
    text, labels, edges, calls = CASES[path]
    rows = EXTRACTORS["." + path.rsplit(".", 1)[1].lower()](path, text)
    assert {r[2] for r in rows if r[0] == "node"} - {path.rsplit("/", 1)[1]} == labels
    got = {(r[3], r[4], r[1]) for r in rows if r[0] == "edge"}
    assert edges <= got, edges - got
    called = {(r[3], r[2]) for r in rows if r[0] in ("call", "member_call")}
    assert calls <= called, (calls - called, called)
    nodes = {r[1] for r in rows if r[0] == "node"}
    assert all(r[3] in nodes or r[0] == "edge" for r in rows if r[3])
    assert EXTRACTORS["." + path.rsplit(".", 1)[1].lower()](path, text.replace("\n", "\r\n"))


def test_odd_texts_of_all_languages(spark):
    files = {f"d/{k}{i}{s}": t for i, s in enumerate(EXTRACTORS) for k, t in enumerate(["", "}{)(", "class", "\x00", "é" * 300 + "{" * 300])}
    from nodeloom.sources import extractors

    rows = extractors.extract(frame(spark, files)).collect()
    assert {r.path for r in rows} == set(files)
