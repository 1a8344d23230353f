"""Languages that are mostly compiled."""

from __future__ import annotations

from ..common import ESCAPE, IDENT, block_comment, comment, double, hash_comment, line_comment, number, single
from ..model import SELF, Keywords, Language, Mode, words

NAME = r"[a-zA-Z_]\w*"


def nested_comment(begin: str, end: str) -> Mode:
    """A comment that may hold others of its kind."""
    out = comment(begin, end)
    out.contains.insert(0, SELF)
    return out


def named(before: str, name: str, scope: str, **more) -> Mode:
    """A keyword, then the name that it introduces."""
    return Mode(match=(before, r"\s+", name), scope={1: "keyword", 3: scope}, **more)


def rust() -> Language:
    types = "i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 str char bool Box Option Result String Vec"
    traits = "Copy Send Sized Sync Drop Fn FnMut FnOnce ToOwned Clone Debug PartialEq PartialOrd Eq Ord AsRef AsMut Into From Default Iterator Extend IntoIterator DoubleEndedIterator ExactSizeIterator SliceConcatExt ToString"
    macros = "assert assert_eq bitflags bytes cfg col concat concat_idents debug_assert debug_assert_eq env eprintln panic file format format_args include_bytes include_str line local_data_key module_path option_env print println select stringify try unimplemented unreachable vec write writeln macro_rules assert_ne debug_assert_ne"
    known = f"{traits} {' '.join(m + '!' for m in macros.split())}"
    raw = rf"(?:r#)?{NAME}"
    sized = "(?:[ui](?:8|16|32|64|128|size)|f(?:32|64))?"
    quoted = Mode(scope="string", begin='b?"', end='"', contains=[ESCAPE])
    return Language(
        "rust",
        Mode(
            illegal="</",
            keywords=words(
                "abstract as async await become box break const continue crate do dyn else enum extern final fn for if impl in let loop macro match mod move mut override priv pub ref return self Self static struct super trait try type typeof union unsafe unsized use virtual where while yield",
                pattern=rf"{IDENT}!?",
                literal="true false Some None Ok Err",
                type=types,
                built_in=known,
            ),
            contains=[
                line_comment(),
                nested_comment(r"/\*", r"\*/"),
                quoted,
                Mode(scope="symbol", begin=rf"'{NAME}(?!')"),
                Mode(scope="string", variants=[Mode(begin=r'b?r(#*)"[\s\S]*?"\1(?!#)'), Mode(begin="b?'", end="'", contains=[Mode(scope="char.escape", match=r"\\('|\w|x\w{2}|u\w{4}|U\w{8})")])]),
                Mode(scope="number", relevance=0, variants=[Mode(begin=rf"\b{digits}{sized}") for digits in ("0b[01_]+", "0o[0-7_]+", "0x[A-Fa-f0-9_]+", r"\d[\d_]*(?:\.[0-9_]+)?(?:[eE][+-]?[0-9_]+)?")]),
                named(r"\bsafe", "extern", "keyword"),
                named("fn", raw, "title.function"),
                Mode(scope="meta", begin=r"#!?\[", end=r"\]", contains=[Mode(scope="string", begin='"', end='"', contains=[ESCAPE])]),
                Mode(match=("let", r"\s+", r"(?:mut\s+)?", raw), scope={1: "keyword", 3: "keyword", 4: "variable"}),
                Mode(match=("for", r"\s+", raw, r"\s+", "in"), scope={1: "keyword", 3: "variable", 5: "keyword"}),
                named("type|trait|enum|struct|union|impl|for", raw, "title.class"),
                Mode(begin=f"{IDENT}::", keywords=words("Self", built_in=known, type=types)),
                Mode(scope="punctuation", begin="->"),
                Mode(scope="title.function.invoke", begin=rf"\b(?!let|for|while|if|else|match\b)(?:r#)?{IDENT}(?=\s*\()", relevance=0),
            ],
        ),
        ("rs",),
    )


def java_number() -> Mode:
    d, h = "[0-9](?:_*[0-9])*", "[0-9a-fA-F](?:_*[0-9a-fA-F])*"
    kinds = (
        rf"(?:\b{d}(?:\.{d}|\.)?|\.{d})[eE][+-]?{d}[fFdD]?\b",
        rf"\b{d}(?:\.{d}[fFdD]?\b|\.(?:[fFdD]\b)?)",
        rf"\.{d}[fFdD]?\b",
        rf"\b{d}[fFdD]\b",
        rf"\b0[xX](?:{h}\.?|(?:{h})?\.{h})[pP][+-]?{d}[fFdD]?\b",
        rf"\b(?:0[xX]{h}|0[bB][01](?:_*[01])*|[1-9](?:_*[0-9])*|0(?:_*[0-7])*)[lL]?\b",
    )
    return Mode(scope="number", relevance=0, variants=[Mode(begin=k) for k in kinds])


def java() -> Language:
    name = r"[À-ʸa-zA-Z_$][À-ʸa-zA-Z_$0-9]*"
    arguments = ""
    for _ in range(3):
        arguments = rf"(?:<{name}{arguments}(?:\s*,\s*{name}{arguments})*>)?"
    keywords = words(
        "synchronized abstract private var static if for while strictfp finally protected import native final void enum else break transient catch instanceof volatile case assert package default public try switch continue throws module requires exports do sealed yield permits goto when",
        literal="false true null",
        type="char boolean long float int byte short double",
        built_in="super this",
    )
    note = Mode(scope="meta", begin=f"@{name}", contains=[Mode(begin=r"\(", end=r"\)", contains=[SELF])])
    doc = comment(r"/\*\*", r"\*/", relevance=0)
    doc.contains[:0] = [Mode(begin=r"\w+@", relevance=0), Mode(scope="doctag", begin="@[A-Za-z]+")]
    params = lambda *inner, **more: Mode(scope="params", begin=r"\(", end=r"\)", keywords=keywords, relevance=0, contains=[*inner, block_comment()], **more)
    return Language(
        "java",
        Mode(
            keywords=keywords,
            illegal="</|#",
            contains=[
                doc,
                Mode(begin=r"import java\.[a-z]+\.", keywords=words("import"), relevance=2),
                line_comment(),
                block_comment(),
                Mode(scope="string", begin='"""', end='"""', contains=[ESCAPE]),
                single(),
                double(),
                named(r"\b(?:class|interface|enum|extends|implements|new)", name, "title.class"),
                Mode(scope="keyword", match="non-sealed"),
                Mode(match=(f"(?!else){name}", r"\s+", name, r"\s+", "=(?!=)"), scope={1: "type", 3: "variable", 5: "operator"}),
                named("record", name, "title.class", contains=[params(ends_parent=True), line_comment(), block_comment()]),
                Mode(begin_keywords="new throw return else", relevance=0),
                Mode(match=(rf"(?:{name}{arguments}\s+)", NAME, r"\s*(?=\()"), scope={2: "title.function"}, keywords=keywords, contains=[params(note, single(), double(), java_number()), line_comment(), block_comment()]),
                java_number(),
                note,
            ],
        ),
        ("jsp",),
    )


def ocaml() -> Language:
    return Language(
        "ocaml",
        Mode(
            illegal="//|>>",
            keywords=words(
                "and as assert asr begin class constraint do done downto else end exception external for fun function functor if in include inherit! inherit initializer land lazy let lor lsl lsr lxor match method!|10 method mod module mutable new object of open! open or private rec sig struct then to try type val! val virtual when while with parser value",
                pattern=r"[a-z_]\w*!?",
                literal="true false",
                built_in="array bool bytes char exn|5 float int int32 int64 list lazy_t|5 nativeint|5 string unit in_channel out_channel ref",
            ),
            contains=[
                Mode(scope="literal", begin=r"\[(\|\|)?\]|\(\)", relevance=0),
                nested_comment(r"\(\*", r"\*\)"),
                Mode(scope="symbol", begin=r"'[A-Za-z_](?!')[\w']*"),
                Mode(scope="type", begin=r"`[A-Z][\w']*"),
                Mode(scope="type", begin=r"\b[A-Z][\w']*", relevance=0),
                # names with apostrophes in them aren't texts
                Mode(begin=r"[a-z_]\w*'[\w']*", relevance=0),
                Mode(scope="string", begin="'", end="'", illegal=r"\n", contains=[ESCAPE], relevance=0),
                Mode(scope="string", begin='"', end='"', contains=[ESCAPE]),
                number(r"\b(0[xX][a-fA-F0-9_]+[Lln]?|0[oO][0-7_]+[Lln]?|0[bB][01_]+[Lln]?|[0-9][0-9_]*([Lln]|(\.[0-9_]*)?([eE][-+]?[0-9_]+)?)?)"),
                Mode(begin="->"),
            ],
        ),
        ("ml",),
    )


# Reserved words and directives.
DELPHI = """
exports register file shl array record property for mod while set ally label uses raise not stored class safecall var interface or private static exit
index inherited to else stdcall override shr asm far resourcestring finalization packed virtual out and protected library do xorwrite goto near function
end div overload object unit begin string on inline repeat until destructor write message program with read initialization except default nil if case
cdecl in downto threadvar of try pascal const external constructor type public then implementation finally published procedure absolute reintroduce
operator as is abstract alias assembler bitpacked break continue cppdecl cvar enumerator experimental platform deprecated unimplemented dynamic export
far16 forward generic helper implements interrupt iochecks local name nodefault noreturn nostackframe oldfpccall otherwise saveregisters softfloat
specialize strict unaligned varargs
"""


def delphi() -> Language:
    remarks = [line_comment(), comment(r"\{", r"\}", relevance=0), comment(r"\(\*", r"\*\)", relevance=10)]
    directive = Mode(scope="meta", variants=[Mode(begin=r"\{\$", end=r"\}"), Mode(begin=r"\(\*\$", end=r"\*\)")])
    text = Mode(scope="string", begin="'", end="'", contains=[Mode(begin="''")])
    code = Mode(scope="string", variants=[Mode(match="#" + p) for p in (r"\d[\d_]*", r"\$[\dA-Fa-f][\dA-Fa-f_]*", "&[0-7][0-7_]*", "%[01][01_]*")])
    title = Mode(scope="title", begin=IDENT, relevance=0)
    kinds = (r"\b\d[\d_]*(\.\d[\d_]*)?", r"\$[\dA-Fa-f_]+", r"\$", "&[0-7][0-7_]*", "%[01_]+", "%")
    return Language(
        "delphi",
        Mode(
            keywords=words(DELPHI),
            illegal=r'"|\$[G-Zg-z]|/\*|</|\|',
            contains=[
                text,
                code,
                Mode(scope="number", relevance=0, variants=[Mode(match=k) for k in kinds]),
                Mode(begin=rf"{IDENT}\s*=\s*class\s*\(", return_begin=True, contains=[title]),
                Mode(
                    scope="function",
                    begin_keywords="function constructor destructor procedure",
                    end="[:;]",
                    keywords=words("function constructor|10 destructor|10 procedure|10"),
                    contains=[title, Mode(scope="params", begin=r"\(", end=r"\)", keywords=words(DELPHI), contains=[text, code, directive, *remarks]), directive, *remarks],
                ),
                directive,
                *remarks,
            ],
        ),
        ("dpr", "dfm", "pas", "pascal"),
        case_insensitive=True,
    )


def zig() -> Language:
    ints = " ".join(f"{sign}{bits}" for sign in "iu" for bits in (8, 16, 32, 64, 128))
    remarks = [line_comment(), block_comment()]
    params = lambda **more: Mode(scope="params", begin=r"\(", end=r"\)", contains=remarks, **more)
    regexp = Mode(scope="regexp", begin=r"/(?=[^/\n]*/)", end=r"/[gimuy]*", contains=[ESCAPE, Mode(begin=r"\[", end=r"\]", relevance=0, contains=[ESCAPE])])
    marks = [
        ("built_in", r"\bmem\.Copy\b"),
        ("meta-event", r"\|[a-zA-Z_]+\|"),
        ("comment-todo", r"//\s*TODO:.*$"),
        ("comment", r"//[^\n]*"),
        ("errorhandling", r"!(?=\w+)"),
        ("optional", r"\?(?=[a-zA-Z_])"),
        ("operator", r"[-+%/*=<>!]=?|&&|\|\||<<=?|>>=?|\*\*|\+\+|--|->"),
        ("property", r"\.\w+"),
    ]
    return Language(
        "zig",
        Mode(
            illegal=r"/\*",
            keywords=Keywords({
                "keyword": "inline while for extern packed export pub noalias comptime volatile align linksection threadlocal allowzero noinline callconv struct enum const union opaque asm unreachable break return continue defer errdefer await resume suspend async nosuspend try catch if else switch orelse usingnamespace test and or bool void type blk",
                "literal": "true false null undefined",
                "built_in": f"std meme {ints} f16 f32 f64 usize isize c_short c_int c_long c_longlong c_ushort c_uint c_ulong c_ulonglong c_float c_double c_void mem",
                "type": "anytype noreturn error anyerror anyframe anyopaque",
            }),
            contains=[
                *[Mode(scope=s, begin=p) for s, p in marks],
                double(),
                single(),
                number(),
                Mode(scope="string", begin=r"@[a-zA-Z_]\w*"),
                Mode(scope="literal", begin=r"\\[xuU][a-fA-F0-9]+"),
                *[Mode(scope="number", begin=p) for p in (r"\b0x[0-9a-fA-F]+", r"\b0b[01]+", r"\b0o[0-7]+", r"\b[0-9]+\b")],
                regexp,
                Mode(scope="function", begin_keywords="fn", end=r"\{", exclude_end=True, contains=[Mode(scope="title", begin=NAME, relevance=0), params(ends_parent=True)]),
                Mode(scope="function-call", begin=rf"{NAME}\(", end=r"\)", exclude_end=True, contains=[params()]),
                Mode(scope="multiline", begin=r"\\", end="$", relevance=0, contains=[Mode(begin=r"\\", end="$", relevance=0)]),
            ],
        ),
        ("zig",),
    )


def ada() -> Language:
    whole = r"\d(?:_|\d)*"
    power = f"(?:[eE][-+]?{whole})?"
    name, bad = r"[A-Za-z](?:_?[A-Za-z0-9.])*", r"\{\}%#'" + '"'
    remark = comment("--", "$")
    hidden = lambda begin, end, scope, **more: Mode(scope=scope, begin=begin, end=end, exclude_begin=True, illegal=bad, **more)
    declared = Mode(
        begin=r"\s+:\s+",
        end=r"\s*(:=|;|\)|=>|$)",
        illegal=bad,
        contains=[Mode(begin_keywords="loop for declare others", ends_parent=True), Mode(scope="keyword", begin_keywords="not null constant access function procedure in out aliased exception"), Mode(scope="type", begin=name, ends_parent=True, relevance=0)],
    )
    return Language(
        "ada",
        Mode(
            keywords=words(
                "abort else new return abs elsif not reverse abstract end accept entry select access exception of separate aliased exit or some all others subtype and for out synchronized array function overriding at tagged generic package task begin goto pragma terminate body private then if procedure type case in protected constant interface is raise use declare range delay limited record when delta loop rem while digits renames with do mod requeue xor parallel",
                literal="True False",
            ),
            contains=[
                remark,
                Mode(scope="string", begin='"', end='"', contains=[Mode(begin='""', relevance=0)]),
                Mode(scope="string", begin="'.'"),
                number(rf"\b(?:{whole}#\w+(?:\.\w+)?#{power}|{whole}(?:\.{whole})?{power})"),
                Mode(scope="symbol", begin=f"'{name}"),
                hidden(r"(\bwith\s+)?(\bprivate\s+)?\bpackage\s+(\bbody\s+)?", "(is|$)", "title", exclude_end=True, keywords=words("package body")),
                Mode(
                    begin=r"(\b(with|overriding)\s+)?\b(function|procedure)\s+",
                    end=r"(\bis|\bwith|\brenames|\)\s*;)",
                    return_begin=True,
                    keywords=words("overriding function procedure with is renames return"),
                    contains=[
                        remark,
                        hidden(r"(\bwith\s+)?\b(function|procedure)\s+", r"(\(|\s+|$)", "title", exclude_end=True),
                        declared,
                        hidden(r"\breturn\s+", r"(\s+|;|$)", "type", exclude_end=True, ends_parent=True, keywords=words("return")),
                    ],
                ),
                hidden(r"\b(sub)?type\s+", r"\s+", "type", keywords=words("type")),
                declared,
            ],
        ),
        case_insensitive=True,
    )


def nim() -> Language:
    suffix = "('?[iIuUfF](8|16|32|64))?"
    kinds = (r"\b(0[xX][0-9a-fA-F][_0-9a-fA-F]*)('?[iIuU](8|16|32|64))?", rf"\b(0o[0-7][_0-7]*){suffix}", rf"\b(0(b|B)[01][_01]*){suffix}", rf"\b(\d[_\d]*){suffix}")
    sized = " ".join(f"{kind}{bits}" for kind, all_bits in (("int", ("", 8, 16, 32, 64)), ("uint", ("", 8, 16, 32, 64)), ("float", ("", 32, 64))) for bits in all_bits)
    return Language(
        "nim",
        Mode(
            keywords=words(
                "addr and as asm bind block break case cast concept const continue converter defer discard distinct div do elif else end enum except export finally for from func generic guarded if import in include interface is isnot iterator let macro method mixin mod nil not notin object of or out proc ptr raise ref return shared shl shr static template try tuple type using var when while with without xor yield",
                literal="true false",
                type=f"{sized} bool char string cstring pointer expr stmt void auto any range array openarray varargs seq set clong culong cchar cschar cshort cint csize clonglong cfloat cdouble clongdouble cuchar cushort cuint culonglong cstringarray semistatic",
                built_in="stdin stdout stderr result",
            ),
            contains=[
                Mode(scope="meta", begin=r"\{\.", end=r"\.\}", relevance=10),
                Mode(scope="string", begin=r'[a-zA-Z]\w*"', end='"', contains=[Mode(begin='""')]),
                Mode(scope="string", begin=r'([a-zA-Z]\w*)?"""', end='"""'),
                double(),
                Mode(scope="type", begin=r"\b[A-Z]\w+\b", relevance=0),
                Mode(scope="number", relevance=0, variants=[Mode(begin=k) for k in kinds]),
                hash_comment(),
            ],
        ),
    )


# Directives, status registers, variables, and mnemonics as patterns.
ARM_DIRECTIVES = ".2byte .4byte .align .ascii .asciz .balign .byte .code .data .else .end .endif .endm .endr .equ .err .exitm .extern .global .hword .if .ifdef .ifndef .include .irp .long .macro .rept .req .section .set .skip .space .text .word .arm .thumb .code16 .code32 .force_thumb .thumb_func .ltorg ALIAS ALIGN ARM AREA ASSERT ATTR CN CODE CODE16 CODE32 COMMON CP DATA DCB DCD DCDU DCDO DCFD DCFDU DCI DCQ DCQU DCW DCWU DN ELIF ELSE END ENDFUNC ENDIF ENDP ENTRY EQU EXPORT EXPORTAS EXTERN FIELD FILL FUNCTION GBLA GBLL GBLS GET GLOBAL IF IMPORT INCBIN INCLUDE INFO KEEP LCLA LCLL LCLS LTORG MACRO MAP MEND MEXIT NOFP OPT PRESERVE8 PROC QN READONLY RELOC REQUIRE REQUIRE8 RLIST FN ROUT SETA SETL SETS SN SPACE SUBT THUMB THUMBX TTL WHILE WEND"
ARM_STATUS = "c x s f cx cxs xs xsf sf cxsf"
ARM_VARIABLES = "{PC} {VAR} {TRUE} {FALSE} {OPT} {CONFIG} {ENDIAN} {CODESIZE} {CPU} {FPU} {ARCHITECTURE} {PCSTOREOFFSET} {ARMASM_VERSION} {INTER} {ROPI} {RWPI} {SWST} {NOSWST} . @"
ARM_MNEMONICS = r"adc|(qd?|sh?|u[qh]?)?add(8|16)?|usada?8|(q|sh?|u[qh]?)?(as|sa)x|and|adrl?|sbc|rs[bc]|asr|b[lx]?|blx|bxj|cbn?z|tb[bh]|bic|bfc|bfi|[su]bfx|bkpt|cdp2?|clz|clrex|cmp|cmn|cpsi[ed]|cps|setend|dbg|dmb|dsb|eor|isb|it[te]{0,3}|lsl|lsr|ror|rrx|ldm(([id][ab])|f[ds])?|ldr((s|ex)?[bhd])?|movt?|mvn|mra|mar|mul|[us]mull|smul[bwt][bt]|smu[as]d|smmul|smmla|mla|umlaal|smlal?([wbt][bt]|d)|mls|smlsl?[ds]|smc|svc|sev|mia([bt]{2}|ph)?|mrr?c2?|mcrr2?|mrs|msr|orr|orn|pkh(tb|bt)|rbit|rev(16|sh)?|sel|[su]sat(16)?|nop|pop|push|rfe([id][ab])?|stm([id][ab])?|str(ex)?[bhd]?|(qd?)?sub|(sh?|q|u[qh]?)?sub(8|16)|[su]xt(a?h|a?b(16)?)|srs([id][ab])?|swpb?|swi|smi|tst|teq|wfe|wfi|yield"


def armasm() -> Language:
    numbered = (("r", 0, 15), ("w", 0, 30), ("x", 0, 30), ("a", 1, 4), ("v", 1, 8), ("f", 0, 7), ("p", 0, 15), ("c", 0, 15), ("q", 0, 15), ("s", 0, 31), ("d", 0, 31))
    registers = [f"{kind}{n}" for kind, first, last in numbered for n in range(first, last + 1)] + "pc lr sp ip sl sb fp".split() + [f"{kind}psr_{fields}" for kind in "cs" for fields in ARM_STATUS.split()]
    remark = Mode(variants=[comment(r"^[ \t]*(?=#)", "$", relevance=0, exclude_begin=True), comment("[;@]", "$", relevance=0), line_comment(), block_comment()])
    marks = r"[a-z_\.\$][a-z0-9_\.\$]+"
    return Language(
        "armasm",
        Mode(
            keywords=words(pattern=rf"\.?{IDENT}", meta=ARM_DIRECTIVES, built_in=f"{' '.join(registers)} {ARM_VARIABLES}"),
            contains=[
                Mode(scope="keyword", begin=rf"\b({ARM_MNEMONICS})(eq|ne|cs|cc|mi|pl|vs|vc|hi|ls|ge|lt|gt|le|al|hs|lo)?[sptrx]?(?=\s)"),
                remark,
                double(),
                Mode(scope="string", begin="'", end=r"[^\\]'", relevance=0),
                Mode(scope="title", begin=r"\|", end=r"\|", illegal=r"\n", relevance=0),
                Mode(scope="number", relevance=0, variants=[Mode(begin=p) for p in ("[#$=]?0x[0-9a-f]+", "[#$=]?0b[01]+", r"[#$=]\d+", r"\b\d+")]),
                Mode(scope="symbol", relevance=0, variants=[Mode(begin=p) for p in (rf"^[ \t]*{marks}:", f"^{marks}", r"[=#]\w+")]),
            ],
        ),
        ("arm",),
        case_insensitive=True,
    )
