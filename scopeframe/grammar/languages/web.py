"""Languages of web servers and of packages."""

from __future__ import annotations

from ..common import ESCAPE, NUMBER, block_comment, comment, hash_comment, line_comment, number
from ..model import SELF, Language, Mode, words

# Words, and classes of the standard library.
PHP_WORDS = "__CLASS__ __DIR__ __FILE__ __FUNCTION__ __COMPILER_HALT_OFFSET__ __LINE__ __METHOD__ __NAMESPACE__ __TRAIT__ die echo exit include include_once print require require_once array abstract and as binary bool boolean break callable case catch class clone const continue declare default do double else elseif empty enddeclare endfor endforeach endif endswitch endwhile enum eval extends final finally float for foreach from global goto if implements instanceof insteadof int integer interface isset iterable list match|0 mixed new never object or private protected public readonly real return string switch throw trait try unset use var void while xor yield"
PHP_CLASSES = "Error|0 AppendIterator ArgumentCountError ArithmeticError ArrayIterator ArrayObject AssertionError BadFunctionCallException BadMethodCallException CachingIterator CallbackFilterIterator CompileError Countable DirectoryIterator DivisionByZeroError DomainException EmptyIterator ErrorException Exception FilesystemIterator FilterIterator GlobIterator InfiniteIterator InvalidArgumentException IteratorIterator LengthException LimitIterator LogicException MultipleIterator NoRewindIterator OutOfBoundsException OutOfRangeException OuterIterator OverflowException ParentIterator ParseError RangeException RecursiveArrayIterator RecursiveCachingIterator RecursiveCallbackFilterIterator RecursiveDirectoryIterator RecursiveFilterIterator RecursiveIterator RecursiveIteratorIterator RecursiveRegexIterator RecursiveTreeIterator RegexIterator RuntimeException SeekableIterator SplDoublyLinkedList SplFileInfo SplFileObject SplFixedArray SplHeap SplMaxHeap SplMinHeap SplObjectStorage SplObserver SplPriorityQueue SplQueue SplStack SplSubject SplTempFileObject TypeError UnderflowException UnexpectedValueException UnhandledMatchError ArrayAccess BackedEnum Closure Fiber Generator Iterator IteratorAggregate Serializable Stringable Throwable Traversable UnitEnum WeakReference WeakMap Directory __PHP_Incomplete_Class parent php_user_filter self static stdClass"


def php() -> Language:
    tail = r"(?![A-Za-z0-9])(?![$])"
    name = rf"[a-zA-Z_\x7f-\xff][a-zA-Z0-9_\x7f-\xff]*{tail}"
    kind = rf"(?:\\?[A-Z][a-z0-9_\x7f-\xff]+|\\?[A-Z]+(?=[A-Z][a-z0-9_\x7f-\xff]))+{tail}"
    upper = f"[A-Z]+{tail}"
    keywords = words(PHP_WORDS, literal="false FALSE null NULL true TRUE", built_in=PHP_CLASSES)
    none_of = lambda listed: r"\b|".join(w.split("|")[0] for w in listed.split())
    variable = Mode(scope="variable", match=rf"\$+{name}")
    hole = Mode(scope="subst", variants=[Mode(begin=r"\$\w+"), Mode(begin=r"\{\$", end=r"\}")])
    text = Mode(
        scope="string",
        variants=[
            Mode(begin='"', end='"', contains=[ESCAPE, hole]),
            Mode(begin="'", end="'", contains=[ESCAPE]),
            *[Mode(begin=rf"<<<[ \t]*{mark}\n", end=r"[ \t]*(\w+)\b", end_same_as_begin=True, contains=[ESCAPE, hole]) for mark in (r"(\w+)", r'"(\w+)"')],
            Mode(begin=r"<<<[ \t]*'(\w+)'\n", end=r"[ \t]*(\w+)\b", end_same_as_begin=True),
        ],
    )
    digits = r"\d+(?:_\d+)*"
    kinds = (r"\b0[bB][01]+(?:_[01]+)*\b", r"\b0[oO][0-7]+(?:_[0-7]+)*\b", r"\b0[xX][\da-fA-F]+(?:_[\da-fA-F]+)*\b", rf"(?:\b{digits}(?:\.{digits})?|\B\.\d+)(?:[eE][+-]?\d+)?")
    numeric = Mode(scope="number", relevance=0, variants=[Mode(begin=k) for k in kinds])
    made = Mode(match=("new", r"[ \t\n]+", rf"(?!{none_of(PHP_CLASSES)}\b)", kind), scope={1: "keyword", 4: "title.class"})
    constant, colons = rf"{name}\b(?!\()", r"::(?=(?!class\b))"
    sides = Mode(
        variants=[
            Mode(match=(colons, constant), scope={2: "variable.constant"}),
            Mode(match=("::", "class"), scope={2: "variable.language"}),
            Mode(match=(kind, colons, constant), scope={1: "title.class", 3: "variable.constant"}),
            Mode(match=(kind, colons), scope={1: "title.class"}),
            Mode(match=(kind, "::", "class"), scope={1: "title.class", 3: "variable.language"}),
        ]
    )
    argument = Mode(scope="attr", match=rf"{name}(?=:)(?!::)")
    arguments = Mode(begin=r"\(", end=r"\)", keywords=keywords, relevance=0)
    call = Mode(match=(r"\b", rf"(?!fn\b|function\b|{none_of(PHP_WORDS)}|{none_of(PHP_CLASSES)}\b)", name, r"[ \t\n]*", r"(?=\()"), scope={3: "title.function.invoke"}, relevance=0, contains=[arguments])
    arguments.contains = [argument, variable, sides, block_comment(), text, numeric, made, call]
    inside = [argument, sides, block_comment(), text, numeric, made]
    few = words("new array", literal="false null true")
    attribute = Mode(
        begin=rf"#\[\s*\\?(?:{kind}|{upper})",
        begin_scope="meta",
        end="]",
        end_scope="meta",
        keywords=few,
        contains=[Mode(begin=r"\[", end="]", keywords=few, contains=[SELF, *inside]), *inside, Mode(scope="meta", variants=[Mode(match=kind), Mode(match=upper)])],
    )
    title = lambda scope="title": Mode(scope=scope, begin=r"[a-zA-Z_]\w*", relevance=0)
    doc = comment(r"/\*", r"\*/")
    doc.contains.insert(0, Mode(scope="doctag", match="@[A-Za-z]+"))
    params = Mode(scope="params", begin=r"\(", end=r"\)", exclude_begin=True, exclude_end=True, keywords=keywords, contains=[SELF, attribute, variable, sides, block_comment(), text, numeric])
    return Language(
        "php",
        Mode(
            keywords=keywords,
            contains=[
                attribute,
                hash_comment(),
                line_comment(),
                doc,
                Mode(match=r"__halt_compiler\(\);", keywords=words("__halt_compiler"), starts=Mode(scope="comment", end=r"\b\B", contains=[Mode(scope="meta", match=r"\?>", ends_parent=True)])),
                Mode(scope="meta", variants=[Mode(begin=r"<\?php", relevance=10), Mode(begin=r"<\?="), Mode(begin=r"<\?", relevance=0.1), Mode(begin=r"\?>")]),
                Mode(scope="variable.language", match=r"\$this\b"),
                variable,
                call,
                sides,
                Mode(match=("const", r"\s", name), scope={1: "keyword", 3: "variable.constant"}),
                made,
                Mode(scope="function", begin_keywords="fn function", end="[;{]", exclude_end=True, relevance=0, illegal=r"[$%\[]", contains=[Mode(begin_keywords="use"), title(), Mode(begin="=>", ends_parent=True), params]),
                Mode(
                    scope="class",
                    end=r"\{",
                    exclude_end=True,
                    relevance=0,
                    contains=[Mode(begin_keywords="extends implements"), title()],
                    variants=[Mode(begin_keywords="enum", illegal=r'[($"]'), Mode(begin_keywords="class interface trait", illegal=r'[:($"]')],
                ),
                Mode(begin_keywords="namespace", end=";", relevance=0, illegal="[.']", contains=[title("title.class")]),
                Mode(begin_keywords="use", end=";", relevance=0, contains=[Mode(scope="keyword", match=r"\b(as|const|function)\b"), title()]),
                text,
                numeric,
            ],
        ),
    )


# Members of builtins.
NIX = "abort add addDrvOutputDependencies addErrorContext all any appendContext attrNames attrValues baseNameOf bitAnd bitOr bitXor break builtins catAttrs ceil compareVersions concatLists concatMap concatStringsSep convertHash currentSystem currentTime deepSeq derivation derivationStrict dirOf div elem elemAt false fetchGit fetchMercurial fetchTarball fetchTree fetchurl filter filterSource findFile flakeRefToString floor foldl' fromJSON fromTOML functionArgs genList genericClosure getAttr getContext getEnv getFlake groupBy hasAttr hasContext hashFile hashString head import intersectAttrs isAttrs isBool isFloat isFunction isInt isList isNull isPath isString langVersion length lessThan listToAttrs map mapAttrs match mul nixPath nixVersion null parseDrvName parseFlakeRef partition path pathExists placeholder readDir readFile readFileType removeAttrs replaceStrings scopedImport seq sort split splitVersion storeDir storePath stringLength sub substring tail throw toFile toJSON toPath toString toXML trace traceVerbose true tryEval typeOf unsafeDiscardOutputDependency unsafeDiscardStringContext unsafeGetAttrPos warn zipAttrsWith"


def nix() -> Language:
    keywords = words("assert else if in inherit let or rec then with", literal="true false null", built_in="abort baseNameOf builtins derivation derivationStrict dirOf fetchGit fetchMercurial fetchTarball fetchTree fromTOML import isNull map placeholder removeAttrs scopedImport throw toString")
    name, piece = "[A-Za-z_][A-Za-z0-9_'-]*", r"[A-Za-z0-9_+.-]+"
    operator = r"(?:==|=|\+\+|\+|<=|<\||<|>=|>|->|//|/|!=|!|\|\||\|>|\?|\*|&&)"
    hole = Mode(scope="subst", begin=r"\$\{", end=r"\}", keywords=keywords)
    escape = lambda pattern: Mode(scope="char.escape", match=pattern)
    other = escape(r"\\(?!\$).")
    text = Mode(scope="string", variants=[Mode(begin="''", end="''", contains=[escape(r"''\$"), hole, escape("'''"), other]), Mode(begin='"', end='"', contains=[escape(r"\\\$"), hole, other])])
    path = rf"{name}(?:\.{name})*"
    # a dash is an operator after a space, a number or another operator
    minus = [
        Mode(scope="operator", before=r"\s", begin="-(?!>)", relevance=0),
        Mode(begin=(NUMBER, "-", "(?!>)"), begin_scope={1: "number", 2: "operator"}, relevance=0),
        Mode(begin=(operator, "-", "(?!>)"), begin_scope={1: "operator", 2: "operator"}, relevance=0),
    ]
    inside = [
        number(rf"{NUMBER}(?!-)"),
        hash_comment(),
        block_comment(),
        comment(r"/\*\*(?!/)", r"\*/", sub_language="markdown", relevance=0),
        Mode(scope="built_in", match="|".join(rf"builtins\.{n}" for n in NIX.split()), relevance=10),
        text,
        Mode(scope="symbol", match=f"<{name}(?:/{name})*>"),
        Mode(scope="symbol", match=rf"(?:\.\.|\.|~)?/(?:{piece})?(?:/{piece})*(?=[\s;])"),
        Mode(scope="params", match=rf"{name}\s*:(?=\s)"),
        Mode(before=r"(^|\{|;)\s*", begin=rf"{path}\s*=(?!=)", return_begin=True, relevance=0, contains=[Mode(scope="attr", match=rf"{path}(?=\s*=)", relevance=0.2)]),
        *minus,
        Mode(scope="operator", match=f"{operator}(?!-)", relevance=0),
    ]
    hole.contains = inside
    session = [Mode(scope="meta.prompt", match=r"^nix-repl>(?=\s)", relevance=10), Mode(scope="meta", before=r"\s+", begin=r":([a-z]+|\?)")]
    return Language("nix", Mode(keywords=keywords, contains=[*inside, *session]), ("nixos",))
