"""Programming and build languages."""

from __future__ import annotations

from ..common import ESCAPE, block_comment, comment, double, hash_comment, line_comment, number, shebang, single
from ..model import SELF, Language, Mode, words


# Commands of shells and of the core utilities.
SHELL = "break cd continue eval exec exit export getopts hash pwd readonly return shift test times trap umask unset alias bind builtin caller command declare echo enable help let local logout mapfile printf read readarray source sudo type typeset ulimit unalias set shopt"
ZSH = "autoload bg bindkey bye cap chdir clone comparguments compcall compctl compdescribe compfiles compgroups compquote comptags comptry compvalues dirs disable disown echotc echoti emulate fc fg float functions getcap getln history integer jobs kill limit log noglob popd print pushd pushln rehash sched setcap setopt stat suspend ttyctl unfunction unhash unlimit unsetopt vared wait whence where which zcompile zformat zftp zle zmodload zparseopts zprof zpty zregexparse zsocket zstyle ztcp"
COREUTILS = "chcon chgrp chown chmod cp dd df dir dircolors ln ls mkdir mkfifo mknod mktemp mv realpath rm rmdir shred sync touch truncate vdir b2sum base32 base64 cat cksum comm csplit cut expand fmt fold head join md5sum nl numfmt od paste ptx pr sha1sum sha224sum sha256sum sha384sum sha512sum shuf sort split sum tac tail tr tsort unexpand uniq wc arch basename chroot date dirname du echo env expr factor groups hostid id link logname nice nohup nproc pathchk pinky printenv printf pwd readlink runcon seq sleep stat stdbuf stty tee test timeout tty uname unlink uptime users who whoami yes"


def bash() -> Language:
    variable = Mode(scope="variable", variants=[Mode(begin=r"\$[\w\d#@][\w\d_]*(?![\w\d])(?![$])"), Mode(begin=r"\$\{", end=r"\}", contains=[SELF, Mode(begin=":-", contains=[])])])
    variable.variants[1].contains[1].contains.append(variable)
    substitution = Mode(scope="subst", begin=r"\$\(", end=r"\)", contains=[ESCAPE])
    quoted = Mode(scope="string", begin='"', end='"', contains=[ESCAPE, variable, substitution])
    substitution.contains.append(quoted)
    here = Mode(begin=r"<<-?\s*(?=\w+)", starts=Mode(contains=[Mode(scope="string", begin=r"(\w+)", end=r"(\w+)", end_same_as_begin=True)]))
    arithmetic = Mode(begin=r"\$?\(\(", end=r"\)\)", contains=[Mode(scope="number", begin=r"\d+#[0-9a-f]+"), number(), variable])
    title = Mode(scope="title", begin=r"\w[\w\d_]*", relevance=0)
    function = Mode(scope="function", begin=r"\w[\w\d_]*\s*\(\s*\)\s*\{", return_begin=True, contains=[title], relevance=0)
    # a hash inside a word begins no comment
    remark = Mode(match=(r"(^|\s)", r"#.*$"), scope={2: "comment"}, contains=hash_comment().contains)
    known = Mode(scope="meta", begin=r"\A#![ ]*/.*\b(?:fish|bash|zsh|sh|csh|ksh|tcsh|dash|scsh)\b.*", end="$", relevance=10)
    return Language(
        "bash",
        Mode(
            keywords=words("if then else elif fi time for while until in do done case esac coproc function select", pattern=r"\b[a-z][a-z0-9._-]+\b", literal="true false", built_in=f"{SHELL} {ZSH} {COREUTILS}"),
            contains=[known, Mode(scope="meta", begin=r"\A#![ ]*/", end="$", relevance=0), function, arithmetic, remark, here, Mode(match=r"(/[a-z._-]+)+"), quoted, Mode(match=r'\\"'), Mode(scope="string", begin="'", end="'"), Mode(match=r"\\'"), variable],
        ),
        ("sh", "zsh"),
    )


def shell() -> Language:
    return Language("shell", Mode(contains=[Mode(scope="meta.prompt", begin=r"^\s{0,3}[/~\w\d[\]()@-]*[>%$#][ ]?", starts=Mode(end=r"[^\\](?=\s*$)", sub_language="bash"))]), ("console", "shellsession"))


def dockerfile() -> Language:
    return Language(
        "dockerfile",
        Mode(
            keywords=words("from maintainer expose env arg user onbuild stopsignal"),
            contains=[hash_comment(), single(), double(), number(r"\b\d+(\.\d+)?"), Mode(begin_keywords="run cmd entrypoint volume add copy workdir label healthcheck shell", starts=Mode(end=r"[^\\]$", sub_language="bash"))],
            illegal="</",
        ),
        ("docker",),
        case_insensitive=True,
    )


def makefile() -> Language:
    variable = Mode(scope="variable", variants=[Mode(begin=r"\$\(\w+\)", contains=[ESCAPE]), Mode(begin=r"\$[@%<?\^\+\*]")])
    quoted = Mode(scope="string", begin='"', end='"', contains=[ESCAPE, variable])
    call = Mode(scope="variable", begin=r"\$\([\w-]+\s", end=r"\)", contains=[variable, quoted], keywords=words(built_in="subst patsubst strip findstring filter filter-out sort word wordlist firstword lastword dir notdir suffix basename addsuffix addprefix join wildcard realpath abspath error warning shell origin flavor foreach if or and call eval file value"))
    return Language(
        "makefile",
        Mode(
            keywords=words("define endef undefine ifdef ifndef ifeq ifneq else endif include -include sinclude override export unexport private vpath", pattern=r"[\w-]+"),
            contains=[
                hash_comment(),
                variable,
                quoted,
                call,
                Mode(begin=r"^[a-zA-Z_][\w]*\s*(?=[:+?]?=)"),
                Mode(scope="meta", begin=r"^\.PHONY:", end="$", keywords=words(keyword=".PHONY", pattern=r"[.\w]+")),
                Mode(scope="section", begin=r"^[^\s]+:", end="$", contains=[variable]),
            ],
        ),
        ("mk", "mak", "make"),
    )


def python() -> Language:
    reserved = "and as assert async await break case class continue def del elif else except finally for from global if import in is lambda match nonlocal|10 not or pass raise return try type while with yield"
    keywords = words(
        reserved,
        pattern=r"[A-Za-z]\w+|__\w+__",
        literal="__debug__ Ellipsis False None NotImplemented True",
        type="Any Callable Coroutine Dict List Literal Generic Optional Sequence Set Tuple Type Union",
        built_in="__import__ abs all any ascii bin bool breakpoint bytearray bytes callable chr classmethod compile complex delattr dict dir divmod enumerate eval exec filter float format frozenset getattr globals hasattr hash help hex id input int isinstance issubclass iter len list locals map max memoryview min next object oct open ord pow print property range repr reversed round set setattr slice sorted staticmethod str sum super tuple type vars zip",
    )
    prompt = Mode(scope="meta", begin=r"^(>>>|\.\.\.) ")
    subst = Mode(scope="subst", begin=r"\{", end=r"\}", keywords=keywords, illegal="#")
    braces = Mode(begin=r"\{\{", relevance=0)
    prefix, plain = r"([uU]|[bB]|[rR]|[bB][rR]|[rR][bB])?", []
    for q in ("'''", '"""'):
        plain.append(Mode(begin=prefix + q, end=q, contains=[ESCAPE, prompt], relevance=10))
        plain.append(Mode(begin=r"([fF][rR]|[rR][fF]|[fF])" + q, end=q, contains=[ESCAPE, prompt, braces, subst]))
    for q in ("'", '"'):
        plain.append(Mode(begin=r"([uU]|[rR])" + q, end=q, relevance=10))
        plain.append(Mode(begin=r"([bB]|[bB][rR]|[rR][bB])" + q, end=q))
        plain.append(Mode(begin=r"([fF][rR]|[rR][fF]|[fF])" + q, end=q, contains=[ESCAPE, braces, subst]))
    text = Mode(scope="string", contains=[ESCAPE], variants=[*plain, single(), double()])
    for v in text.variants[-2:]:
        v.scope = None
    digits = r"[0-9](_?[0-9])*"
    # a number may touch the word that follows
    after = rf"(?=\b|{'|'.join(w.split('|')[0] for w in reserved.split())})"
    numeric = Mode(
        scope="number",
        relevance=0,
        variants=[Mode(begin=p) for p in (rf"(\b({digits})|((\b({digits}))?\.({digits})|\b({digits})\.))[eE][+-]?({digits})[jJ]?{after}", rf"((\b({digits}))?\.({digits})|\b({digits})\.)[jJ]?", rf"\b([1-9](_?[0-9])*|0+(_?0)*)[lLjJ]?{after}", rf"\b0[bB](_?[01])+[lL]?{after}", rf"\b0[oO](_?[0-7])+[lL]?{after}", rf"\b0[xX](_?[0-9a-fA-F])+[lL]?{after}", rf"\b({digits})[jJ]{after}")],
    )
    remark = hash_comment()
    params = Mode(scope="params", variants=[Mode(scope=None, begin=r"\(\s*\)", skip=True), Mode(begin=r"\(", end=r"\)", exclude_begin=True, exclude_end=True, keywords=keywords, contains=[SELF, prompt, numeric, text, remark])])
    subst.contains = [text, numeric, prompt]
    name = r"[^\W\d]\w*"
    return Language(
        "python",
        Mode(
            keywords=keywords,
            illegal=r"(</|\?)|=>",
            contains=[
                prompt,
                numeric,
                Mode(scope="variable.language", match=r"\bself\b"),
                Mode(begin_keywords="if", relevance=0),
                Mode(match=r"\bor\b", scope="keyword"),
                text,
                remark,
                Mode(match=(r"\bdef", r"\s+", name), scope={1: "keyword", 3: "title.function"}, contains=[params]),
                Mode(scope={1: "keyword", 3: "title.class", 6: "title.class.inherited"}, variants=[Mode(match=(r"\bclass", r"\s+", name, r"\s*", r"\(\s*", name, r"\s*\)")), Mode(match=(r"\bclass", r"\s+", name))]),
                Mode(scope="meta", begin=r"^[\t ]*@", end=r"(?=#)|$", contains=[numeric, params, text]),
            ],
        ),
        ("py", "gyp", "ipython"),
    )


def go() -> Language:
    keywords = words(
        "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
        type="bool byte complex64 complex128 error float32 float64 int8 int16 int32 int64 string uint8 uint16 uint32 uint64 int uint uintptr rune",
        literal="true false iota nil",
        built_in="append cap close complex copy imag len make new panic print println real recover delete",
    )
    numeric = Mode(scope="number", relevance=0, variants=[Mode(match=p) for p in (r"-?\b0[xX]\.[a-fA-F0-9](_?[a-fA-F0-9])*[pP][+-]?\d(_?\d)*i?", r"-?\b0[xX](_?[a-fA-F0-9])+((\.([a-fA-F0-9](_?[a-fA-F0-9])*)?)?[pP][+-]?\d(_?\d)*)?i?", r"-?\b0[oO](_?[0-7])*i?", r"-?\.\d(_?\d)*([eE][+-]?\d(_?\d)*)?i?", r"-?\b\d(_?\d)*(\.(\d(_?\d)*)?)?([eE][+-]?\d(_?\d)*)?i?")])
    return Language(
        "go",
        Mode(
            keywords=keywords,
            illegal="</",
            contains=[
                line_comment(),
                block_comment(),
                Mode(scope="string", variants=[double(), single(), Mode(begin="`", end="`")]),
                numeric,
                Mode(begin=":="),
                Mode(scope="function", begin_keywords="func", end=r"\s*(\{|$)", exclude_end=True, contains=[Mode(scope="title", begin=r"[a-zA-Z]\w*", relevance=0), Mode(scope="params", begin=r"\(", end=r"\)", ends_parent=True, keywords=keywords, illegal="[\"']")]),
            ],
        ),
        ("golang",),
    )


def lua() -> Language:
    opened = comment(r"--\[=*\[", r"\]=*\]", relevance=10)
    held = Mode(begin=r"\[=*\[", end=r"\]=*\]", contains=[SELF])
    opened.contains.insert(0, held)
    remarks = [comment(r"--(?!\[=*\[)", "$"), opened]
    return Language(
        "lua",
        Mode(
            keywords=words("and break do else elseif end for goto if in local not or repeat return then until while", pattern=r"[a-zA-Z_]\w*", literal="true false nil", built_in="_G _ENV _VERSION assert collectgarbage dofile error getmetatable ipairs load loadfile next pairs pcall print rawequal rawget rawset require select setmetatable tonumber tostring type xpcall self coroutine string table math io os debug"),
            contains=[
                *remarks,
                Mode(scope="function", begin_keywords="function", end=r"\)", contains=[Mode(scope="title", begin=r"([_a-zA-Z]\w*\.)*([_a-zA-Z]\w*:)?[_a-zA-Z]\w*", relevance=0), Mode(scope="params", begin=r"\(", ends_with_parent=True, contains=remarks), *remarks]),
                number(),
                single(),
                double(),
                Mode(scope="string", begin=r"\[=*\[", end=r"\]=*\]", contains=[held], relevance=5),
            ],
        ),
        ("pluto",),
    )


def sql() -> Language:
    reserved = "all alter and any array as asc at authorization begin between both by call case cast check collate column commit connect constraint create cross cube current cursor declare default delete deref describe desc distinct drop each else end escape except execute exists fetch filter for foreign from full function grant group grouping having in inner insert intersect interval into is join lateral leading left like limit local natural no not null of offset on only open or order outer over partition primary procedure range recursive references release returning returns revoke right rollback rollup row rows select set similar some start table tablesample then to trailing trigger truncate union unique unknown update user using values view when where window with within without first last key nulls"
    functions = "abs avg cast ceil ceiling coalesce count cume_dist dense_rank exp extract first_value floor lag last_value lead listagg ln lower max min mod ntile nullif percent_rank position power rank row_number sqrt substring sum trim upper"
    types = "bigint binary blob boolean char character clob date dec decfloat decimal float int integer nchar nclob national numeric real row smallint time timestamp varchar varying varbinary"
    own = "|".join(functions.split())
    # of the words that are no functions, those of one or two letters say little
    kept = " ".join(f"{w}|0" if len(w) < 3 else w for w in reserved.split() if w not in functions.split())
    # Words that go together.
    pairs = "create table, insert into, primary key, foreign key, not null, alter table, add constraint, grouping sets, on overflow, character set, respect nulls, ignore nulls, nulls first, nulls last, depth first, breadth first"
    together = "|".join(r"\s+".join(x.split()) for x in pairs.split(","))
    return Language(
        "sql",
        Mode(
            illegal=r"[{}]|</",
            keywords=words(kept, pattern=r"\b[\w\.]+", literal="true false unknown", type=types, built_in="current_catalog current_date current_path current_role current_schema current_time current_timestamp current_user session_user localtime localtimestamp"),
            contains=[
                Mode(scope="keyword", match=rf"\b(?:{together})(?![\w.])", relevance=0),
                Mode(begin=rf"\b(?:{own})\s*\(", relevance=0, keywords=words(built_in=functions)),
                Mode(scope="variable", match=r"@[a-z0-9][a-z0-9_]*"),
                Mode(scope="string", variants=[Mode(begin="'", end="'", contains=[Mode(match="''")])]),
                Mode(begin='"', end='"', contains=[Mode(match='""')]),
                number(),
                block_comment(),
                comment("--", "$"),
                Mode(scope="operator", begin=r"[-+*/=%^~]|&&?|\|\|?|!=?|<(?:=>?|<|>)?|>[>=]?", relevance=0),
            ],
        ),
        case_insensitive=True,
    )
