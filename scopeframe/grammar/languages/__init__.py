"""The bundled languages and by what file names they go."""

from __future__ import annotations

from ..model import Hints
from . import code, compiled, config, data, dialects, ecma, functional, objects, scripts, symbolic, web

FACTORIES = {
    f.__name__: f
    for f in (
        data.plaintext, data.json, data.diff, data.ini, data.properties, data.http, data.graphql, data.protobuf, data.xml, data.yaml, data.css, data.markdown,
        code.bash, code.shell, code.dockerfile, code.makefile, code.python, code.go, code.lua, code.sql, ecma.javascript, ecma.typescript,
        objects.csharp, objects.cpp, objects.c, objects.objectivec, objects.ruby, objects.swift,
        compiled.rust, compiled.java, compiled.ocaml, compiled.delphi, compiled.zig, compiled.ada, compiled.nim, compiled.armasm,
        config.terraform, config.cmake, config.nginx, config.fish, config.dos, config.apache, config.leaf, config.powershell,
        symbolic.prolog, symbolic.lisp, symbolic.matlab, symbolic.elixir, symbolic.scheme, web.php, web.nix,
        functional.haskell, functional.elm, functional.erlang, functional.scala,
        dialects.basic, dialects.clojure, dialects.fortran, dialects.fsharp, dialects.less, dialects.llvm, dialects.perl, dialects.scss, dialects.stylus, dialects.vim,
        scripts.kotlin, scripts.groovy, scripts.r, scripts.coffeescript, scripts.dart, scripts.applescript,
    )
}

HINTS = {
    "ada": Hints.of("adb ads ada"),
    "apache": Hints.of("apacheconf vhost", ".htaccess"),
    "applescript": Hints.of("applescript scpt", "", "osascript"),
    "armasm": Hints.of("s asm"),
    "bash": Hints.of("bash sh bats", ".bashrc .bash_profile .profile", "bash sh"),
    "basic": Hints.of("bas"),
    "c": Hints.of("c h"),
    "clojure": Hints.of("clj cljs cljc edn", "", "clojure"),
    "cmake": Hints.of("cmake", "cmakelists.txt"),
    "coffeescript": Hints.of("coffee litcoffee", "", "coffee"),
    "cpp": Hints.of("cc cp cpp cxx h hh hpp hxx"),
    "csharp": Hints.of("cs csx"),
    "css": Hints.of("css"),
    "dart": Hints.of("dart", "", "dart"),
    "delphi": Hints.of("pas dpr"),
    "diff": Hints.of("diff patch"),
    "dockerfile": Hints.of("dockerfile", "dockerfile containerfile"),
    "dos": Hints.of("bat cmd", "", "cmd"),
    "elixir": Hints.of("ex exs", "mix.exs", "elixir"),
    "elm": Hints.of("elm"),
    "erlang": Hints.of("erl hrl", "rebar.config", "escript"),
    "fish": Hints.of("fish", "config.fish", "fish"),
    "fortran": Hints.of("f for f77 f90 f95 f03 f08"),
    "fsharp": Hints.of("fs fsi fsx", "", "dotnet-fsi fsi"),
    "go": Hints.of("go"),
    "graphql": Hints.of("graphql gql graphqls"),
    "groovy": Hints.of("groovy gradle", "jenkinsfile", "groovy"),
    "haskell": Hints.of("hs lhs", "", "runhaskell"),
    "http": Hints.of("http"),
    "ini": Hints.of("ini cfg prefs pro properties toml"),
    "java": Hints.of("java"),
    "javascript": Hints.of("js mjs cjs jsx", "", "node nodejs"),
    "json": Hints.of("json jsonc geojson", ".babelrc .eslintrc composer.lock"),
    "kotlin": Hints.of("kt kts", "", "kotlin"),
    "leaf": Hints.of("leaf"),
    "less": Hints.of("less"),
    "lisp": Hints.of("lisp lsp cl"),
    "llvm": Hints.of("ll"),
    "lua": Hints.of("lua", "", "lua luajit"),
    "makefile": Hints.of("mk mak", "makefile gnumakefile bsdmakefile"),
    "markdown": Hints.of("md markdown mdown mkd", "readme"),
    "matlab": Hints.of("m", "", "matlab"),
    "nginx": Hints.of("nginx nginxconf", "nginx.conf"),
    "nim": Hints.of("nim nims nimble", "", "nim"),
    "nix": Hints.of("nix", "", "nix-shell"),
    "objectivec": Hints.of("h m mm"),
    "ocaml": Hints.of("ml mli", "", "ocaml"),
    "perl": Hints.of("pl pm pod t", "", "perl"),
    "php": Hints.of("php php3 php4 php5 phtml", "composer.json", "php"),
    "plaintext": Hints.of("txt text"),
    "powershell": Hints.of("ps1 psm1 psd1", "", "pwsh powershell"),
    "prolog": Hints.of("pro prolog", "", "swipl"),
    "properties": Hints.of("properties"),
    "protobuf": Hints.of("proto"),
    "python": Hints.of("py pyw pyi", "sconstruct wscript", "python python2 python3 pypy"),
    "r": Hints.of("r rmd", ".rprofile", "rscript"),
    "ruby": Hints.of("rb rake gemspec", "gemfile rakefile podfile brewfile", "ruby"),
    "rust": Hints.of("rs"),
    "scala": Hints.of("scala sc", "", "scala"),
    "scheme": Hints.of("scm ss", "", "scheme guile"),
    "scss": Hints.of("scss"),
    "shell": Hints.of("shell-session"),
    "sql": Hints.of("sql"),
    "stylus": Hints.of("styl"),
    "swift": Hints.of("swift", "package.swift", "swift"),
    "terraform": Hints.of("tf tfvars hcl", ".terraformrc"),
    "typescript": Hints.of("ts tsx d.ts mts cts", "", "ts-node deno"),
    "vim": Hints.of("vim", ".vimrc gvimrc", "vim"),
    "xml": Hints.of("xml html htm xhtml svg plist storyboard xib"),
    "yaml": Hints.of("yaml yml", ".clang-format .clang-tidy"),
    "zig": Hints.of("zig zon"),
}
