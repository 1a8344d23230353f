"""Languages written from their own manuals: Clojure, Fortran, F#, LLVM, Perl, Vim script, BASIC, and the style sheets that extend CSS."""

from __future__ import annotations

from ..common import ESCAPE, block_comment, comment, double, hash_comment, line_comment, number, single
from ..model import SELF, Language, Mode, words
from .compiled import nested_comment


def clojure() -> Language:
    """The reader's forms (clojure.org, The Reader); the first symbol of a list is its name, and what a definition names its title."""
    # Definitions, special forms and the most used names of clojure.core.
    defining = "def defonce defprotocol defstruct defmulti defmethod defn- defn defmacro deftype defrecord"
    core = """
    cond apply if-not if-let if not not= neg? pos? keyword? true? false? empty? coll? list? set? fn? seq? vector? string? map? nil? contains? zero? instance?
    odd? even? -> ->> .. inc compare do dotimes mapcat take remove take-while drop letfn drop-while case reduced split-at split-with repeat cycle iterate range
    merge zipmap declare sort sort-by dorun doall partition eval doseq let agent atom send quote var fn loop recur throw try for dosync and or when when-not
    when-let comp partial memoize constantly complement identity assert peek pop doto first rest cons last butlast second meta with-meta ns import refer keys
    vals key val namespace into conj! assoc! class type num print printf format get-in update-in pr newline slurp read-line subvec with-open time re-find rand-int
    rand mod locking resolve ref deref swap! reset! alter ref-set new next conj set! future reduce map filter find empty hash-map hash-set vec vector seq flatten
    reverse assoc dissoc list disj get union difference extend-type nth delay count concat max min dec prn lazy-seq str keyword symbol gensym catch finally
    """
    sign = r"!#$%&*+\-./:<=>?_|'"
    symbol = rf"[A-Za-z_\-!.?+*=<>&'%$/|#][\w{sign}]*"
    figures = [r"0[xX][0-9a-fA-F]+N?", r"0[0-7]+N?", r"(?:[1-9]|[12]\d|3[0-6])[rR][0-9a-zA-Z]+N?", r"\d+/\d+N?", r"\d+(?:\.\d*)?(?:[eE][-+]?\d+)?[MN]?"]
    atoms = [
        comment(";", "$", relevance=0),
        Mode(scope="character", relevance=0, variants=[Mode(match=r"\\(?:u[0-9A-Fa-f]{4}|o[0-3]?[0-7]{1,2})", relevance=1), Mode(match=r"\\(?:newline|space|tab|formfeed|backspace|return)", relevance=1), Mode(match=r"\\\S")]),
        Mode(scope="regex", begin='#"', end='"', contains=[ESCAPE]),
        Mode(scope="string", begin='"', end='"', contains=[ESCAPE]),
        Mode(scope="punctuation", match=r",+", relevance=0),
        *[Mode(scope="number", match=rf"(?<![\w{sign}])[-+]?{p}(?![\w{sign}])", relevance=0) for p in figures],
        Mode(scope="symbol", match=rf"::?{symbol}"),
        Mode(scope="literal", match=rf"\b(?:true|false|nil)(?![\w{sign}])", relevance=0),
    ]
    vector = Mode(begin=r"[\[{]", end=r"[\]}]", relevance=0)
    quoted = Mode(match=symbol, relevance=0)
    definition = Mode(begin=rf"\((?=(?:{'|'.join(sorted(defining.split(), key=len, reverse=True))})\s)", end=r"\)")
    rest = Mode(ends_with_parent=True, relevance=0)
    title = Mode(scope="title", match=symbol, relevance=0, starts=rest)
    definition.contains = [Mode(scope="keyword", match=rf"(?<=\(){symbol}"), Mode(scope="symbol", match=rf":{symbol}"), title]
    head = Mode(scope="name", match=rf"(?<=\(){symbol}", relevance=0, keywords=words(pattern=rf"[\w{sign}]+", built_in=core))
    form = Mode(begin=r"\(", end=r"\)", contains=[head, *atoms, vector, definition, SELF, quoted])
    vector.contains = [*atoms, SELF, definition, form, quoted]
    rest.contains = [*atoms, vector, definition, form, quoted]
    return Language("clojure", Mode(illegal=r"\S", contains=[*atoms, Mode(scope="meta", match=r"\A#!.*", relevance=0), definition, form, vector, Mode(match=rf"[#'`~@^]*(?:{symbol})?", relevance=0)]), ("clj", "edn"))


def fortran() -> Language:
    """Free and fixed form of the Fortran standard: statements' words, dotted operators, kinds after numbers."""
    # Words of statements and attributes; intrinsic procedures.
    statements = """
    kind do concurrent while private call intrinsic where elsewhere type endtype endmodule endselect endinterface end enddo endif if forall endforall only contains
    default return stop then block endblock endassociate public subroutine|10 function program .and. .or. .not. .le. .eq. .ge. .gt. .lt. .ne. .eqv. .neqv. goto
    save else use module select case access file fmt form iostat name named status unit continue format pause cycle exit flush wait pass protected volatile abstract
    extends import value deferred generic final enumerator class associate bind enum contiguous recursive interface procedure namelist include sequence elemental
    pure impure integer real character complex logical codimension dimension allocatable|10 parameter external implicit|10 none double precision assign intent
    optional pointer target in out common equivalence data
    """
    procedures = """
    float abs acos aimag aint anint asin atan atan2 char cmplx conjg cos cosh exp ichar index int log log10 max min nint sign sin sinh sqrt tan tanh print write
    read open close inquire rewind dim mod nullify allocate deallocate adjustl adjustr all allocated any associated bit_size btest ceiling count cshift digits
    dot_product eoshift epsilon exponent floor fraction huge iand ibclr ibits ibset ieor ior ishft lbound len len_trim matmul maxloc maxval merge minloc minval modulo
    nearest pack present product radix random_number random_seed range repeat reshape scale scan selected_int_kind selected_real_kind shape size spacing spread sum
    system_clock tiny transpose trim ubound unpack verify achar iachar transfer dble dprod cpu_time move_alloc new_line acosh asinh atanh erf erfc gamma log_gamma
    hypot norm2 findloc popcnt this_image num_images co_sum
    """
    figures = r"(?:\b\d+(?:\.\d*)?|(?<!\w)\.\d+)(?:[deDE][-+]?\d+)?(?:_[a-zA-Z]\w*)?"
    keywords = words(statements, pattern=r"\b[a-z][a-z0-9_]+\b|\.[a-z][a-z0-9_]+\.", literal=".true. .false.", built_in=procedures)
    return Language(
        "fortran",
        Mode(
            keywords=keywords,
            illegal=r"/\*",
            contains=[
                Mode(scope="string", relevance=0, variants=[Mode(begin="'", end="'"), Mode(begin='"', end='"')], contains=[ESCAPE]),
                Mode(scope="function", match=r"\b(?:subroutine|function|program)\b", keywords=words("subroutine function program"), relevance=0),
                # C and d in the first column make a comment, but no assignment to a variable of that name
                comment(r"^[cC*](?=[ \t!]|$)(?!\s*=(?!=))", "$", relevance=0),
                comment("!", "$", relevance=0),
                number(rf"{figures}(?![\w])"),
            ],
        ),
        ("f90", "f95"),
        case_insensitive=True,
    )


def fsharp() -> Language:
    """Tokens of the F# language specification (3.1 to 3.11)."""
    # The language's words.
    reserved = "abstract and as assert base begin class default delegate do done downcast downto elif else end exception extern finally fixed for fun function global if in inherit inline interface internal lazy let match member module mutable namespace new of open or override private public rec return static struct then to try type upcast use val void when while with yield"
    types = "bool byte sbyte int8 int16 int32 uint8 uint16 uint32 int uint int64 uint64 nativeint unativeint decimal float double float32 single char string unit bigint option voption list array seq byref exn obj enum"
    bang = "yield! return! let! do! match! use! and! while!"
    values = "not ref raise reraise dict readOnlyDict set get failwith failwithf sizeof typeof typedefof nameof invalidArg nullArg invalidOp id fst snd ignore lock using box unbox tryUnbox printf printfn sprintf eprintf eprintfn fprintf fprintfn"
    name, tick = r"(?:[A-Za-z_][\w']*|``[^`\n]+``)", r"'[a-zA-Z_]\w*(?!')"
    keywords = words(reserved, literal="true false null Some None Ok Error infinity infinityf nan nanf", built_in=values, **{"variable.constant": "__LINE__ __SOURCE_DIRECTORY__ __SOURCE_FILE__"})
    remarks = [nested_comment(r"\(\*(?!\))", r"\*\)"), line_comment()]
    escape = Mode(scope="char.escape", match=r"\\(?:[\"'\\ntbrafv0]|\d{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})", relevance=0)
    hole = Mode(scope="subst", begin=r"\{(?!\{)", end=r"\}", keywords=keywords)
    texts = [
        Mode(scope="string", begin=r'\$+"""', end='"""', contains=[Mode(match=r"\{\{|\}\}"), hole]),
        Mode(scope="string", begin='"""', end='"""'),
        Mode(scope="string", begin=r'\$@"|@\$"', end='"', contains=[Mode(match='""'), Mode(match=r"\{\{|\}\}"), hole]),
        Mode(scope="string", begin='@"', end='"', contains=[Mode(match='""')]),
        Mode(scope="string", begin=r'\$"', end='"', contains=[escape, Mode(match=r"\{\{|\}\}"), hole]),
        Mode(scope="string", begin='"', end='"', contains=[escape]),
        Mode(scope="string", match=r"'(?:[^\\'\n]|\\(?:.|\d{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'"),
    ]
    numeric = number(r"(?<![\w.])(?:0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|\d[\d_]*(?:\.(?!\.)[\d_]*)?(?:[eE][-+]?[\d_]+)?)(?:[uU]?[yslnLI]{0,2}|[mMfF]|LF|lf)?(?!\w)")
    hole.contains = [*texts, numeric]
    kinds = words(types)
    annotation = Mode(
        begin=(":", r"\s*", r"(?=[A-Za-z_('#])"),
        begin_scope={1: "operator"},
        end=r"(?=[\n=,)}\];|{]|->)",
        relevance=0,
        keywords=words(reserved, type=types),
        contains=[*remarks, Mode(scope="symbol", match=tick), Mode(match=r"\(", relevance=0), Mode(scope="operator", match=r"\*|->")],
    )
    declared = Mode(begin=(r"\b(?:type)", r"\s+", name), begin_scope={1: "keyword", 3: "title.class"}, end=r"(?=[=(\n])", relevance=1, keywords=kinds, contains=[*remarks, Mode(scope="symbol", match=tick)])
    attribute = Mode(scope="meta", begin=r"\[<(?=\s*[A-Za-z_(])", end=r">\]", relevance=2, contains=[*texts, numeric])
    return Language(
        "fsharp",
        Mode(
            keywords=keywords,
            illegal=r"/\*",
            contains=[
                Mode(scope="keyword", match=rf"\b(?:{'|'.join(bang.split())})"),
                *texts,
                *remarks,
                declared,
                attribute,
                Mode(scope="meta", begin=r"^\s*#(?:if|else|endif|line|nowarn|light|r|i|I|load|time|help|quit)\b", end="$", relevance=1, contains=[*texts, numeric]),
                annotation,
                Mode(scope="symbol", match=tick, relevance=0),
                numeric,
                Mode(match=r"``[^`\n]+``", relevance=0),
                Mode(scope="operator", match=r"<-|->|:>|:\?>?|\|>|<\||>>|<<|&&|\|\||<>|[!%&*+\-/<=>@^|~?]+|\.\.", relevance=0),
            ],
        ),
        ("fs", "f#"),
    )


def llvm() -> Language:
    """Tokens of the LLVM language reference."""
    # The language's words, but operations on numbers and comparisons, which are made below.
    listed = """
    begin end true false declare define global constant private internal available_externally linkonce linkonce_odr weak weak_odr appending dllimport dllexport
    common default hidden protected extern_weak external thread_local zeroinitializer undef null to tail target triple datalayout volatile nuw nsw nnan ninf nsz
    arcp fast exact inbounds align addrspace section alias module asm sideeffect gc dbg attributes blockaddress initialexec localdynamic localexec prefix
    unnamed_addr ccc fastcc coldcc cc c signext zeroext inreg sret nounwind noreturn noalias nocapture byval nest readnone readonly inlinehint noinline
    alwaysinline optsize ssp sspreq noredzone noimplicitfloat naked builtin cold nobuiltin noduplicate nonlazybind optnone returns_twice uwtable returned type
    acq_rel acquire alignstack atomic catch cleanup filter inteldialect max min monotonic nand personality release seq_cst singlethread umax umin unordered
    shl lshr ashr and or xor phi call trunc zext sext fptrunc fpext uitofp sitofp fptoui fptosi inttoptr ptrtoint bitcast addrspacecast select va_arg ret br
    switch invoke unwind unreachable indirectbr landingpad resume alloca load store getelementptr extractelement insertelement shufflevector extractvalue
    insertvalue atomicrmw cmpxchg xchg fence x
    """
    made = [f"{k}{o}" for o in ("add", "sub", "mul", "div", "rem") for k in ("", "f", "u", "s")] + [f"{k}cmp" for k in "if"] + ["eq", "ne", "ord", "uno"] + [f"{k}{o}" for k in "suo" for o in ("gt", "ge", "lt", "le")] + [f"{k}{o}" for k in "uo" for o in ("eq", "ne")]
    name = r"[-a-zA-Z$._][\w\-$.]*"
    text = Mode(scope="string", begin='"', end='"', contains=[Mode(scope="char.escape", match=r"\\[0-9a-fA-F]{2}")])
    return Language(
        "llvm",
        Mode(
            keywords=words(f"{listed} {' '.join(made)}", pattern=r"[a-zA-Z_][\w.]*", type="void half bfloat float double fp128 x86_fp80 ppc_fp128 x86_amx ptr label token metadata opaque"),
            contains=[
                Mode(scope="type", match=r"\bi\d+(?=[\s*,)\]>}]|\b)"),
                comment(";\\s*$", "(?=\\n)", relevance=0),
                comment(";", "$"),
                text,
                Mode(scope="title", match=rf"@(?:{name}|\d+)"),
                Mode(scope="punctuation", match=r",", relevance=0),
                Mode(scope="operator", match=r"=", relevance=0),
                Mode(scope="variable", match=rf"%(?:{name}|\d+)|#\d+", relevance=1),
                Mode(scope="symbol", match=rf"!(?:{name}|\d+)|^\s*[a-zA-Z][\w.]*:", relevance=1),
                Mode(scope="number", relevance=0, match=r"[su]0x[0-9a-fA-F]+|\b0x[KLMHR]?[0-9a-fA-F]+|(?<![\w.%@$-])[-+]?\d+(?:\.\d*(?:[eE][-+]?\d+)?)?(?![\w.])"),
            ],
        ),
    )


def perl() -> Language:
    """Perl's syntax by perlsyn, perldata, perlop and perlclass."""
    # Words of the language and its most used functions.
    listed = """
    abs accept and atan2 bind binmode bless break caller chdir chmod chomp chop chown chr chroot class close closedir connect continue cos crypt defined delete die do
    dump each else elsif endpwent eof eval exec exists exit exp field fileno flock for foreach fork format formline getc getppid given glob gmtime goto grep hex if
    import index int ioctl join keys kill last lc lcfirst length link listen local localtime log lstat lt ma map method mkdir my ne next no not oct open opendir or ord our
    pack package pipe pop pos print printf prototype push quotemeta rand read readdir readline readlink recv redo ref rename require reset return reverse rewinddir
    rindex rmdir say scalar seek select semctl send setsockopt shift shutdown sin sleep socket sort splice split sprintf sqrt srand stat state study sub substr symlink
    syscall sysopen sysread system syswrite tell tie tied time times truncate uc ucfirst umask undef unless unlink unpack unshift untie until use utime values vec wait
    waitpid wantarray warn when while write xor eq ge gt le cmp x ADJUST try catch finally defer isa
    """
    keywords = words(listed, pattern=r"[\w.]+")
    digits = r"\d(?:_?\d)*"
    numeric = Mode(scope="number", relevance=0, match=rf"(?<![\w$@%&])(?:v\d+(?:\.\d+)*|0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[bB][01](?:_?[01])*|{digits}(?:\.(?:{digits})?)?(?:[eE][-+]?{digits})?|\.{digits})")
    traits = Mode(scope="attr", match=r"\s*:\s*\w+(?:\([^()\n]*\))?(?:\s*:\s*\w+(?:\([^()\n]*\))?)*", relevance=1)
    plain = Mode(scope="variable", match=r"\$[!-/:-@\[-`{-~](?=\W)|[$@%]\$*(?:\^[A-Z]|\w+(?:::\w+)*|#\w+)|\$#\$?\w+", relevance=1)
    hole = Mode(scope="subst", begin=r"[$@]\{", end=r"\}", keywords=keywords)
    inner = [ESCAPE, hole, plain]
    pairs = {"(": ")", "[": "]", "{": "}", "<": ">"}
    delimited = lambda word, scope, live, tail="": [Mode(scope=scope, begin=rf"\b{word}\s*\{a}", end=rf"\{b}{tail}", contains=inner if live else [ESCAPE], relevance=5) for a, b in pairs.items()] + [Mode(scope=scope, begin=rf"\b{word}\s*([/|!#])", end=rf"([/|!#]){tail}", end_same_as_begin=True, contains=inner if live else [ESCAPE], relevance=5)]
    texts = [
        *delimited("q[qwxr]?", "string", True),
        Mode(scope="string", begin="'", end="'", contains=[ESCAPE], relevance=0),
        Mode(scope="string", begin='"', end='"', contains=inner, relevance=0),
        Mode(scope="string", begin="`", end="`", contains=[ESCAPE], relevance=0),
        Mode(scope="string", begin=r"<<[~]?(['\"]?)(\w+)\1;?", end=r"^\s*(\w+)$", on_begin=lambda m, data: data.update(word=m[2]), on_end=lambda m, data: m[1] != data.get("word"), relevance=5),
    ]
    changes = r"(?:\\.|[^\\/\n])*"
    patterns = [
        *delimited("m", "regexp", False, "[dualxmsipngr]*"),
        Mode(scope="regexp", match=rf"\b(?:s|tr|y)/{changes}/{changes}/[a-z]*", relevance=10),
        Mode(scope="regexp", match=r"\b(?:s|tr|y)\s*\{(?:\\.|[^\\{}])*\}\s*\{(?:\\.|[^\\{}])*\}[a-z]*", relevance=10),
        Mode(match=(r"(?:=~|!~|\(|,|\b(?:split|return|and|or|if|unless|grep|not)\b)", r"\s*", r"/(?:\\.|[^\\/\n])+/[a-z]*"), scope={1: "", 3: "regexp"}, relevance=0),
    ]
    name = r"[A-Za-z_]\w*"
    sub = Mode(scope="function", begin=r"\b(?:sub|method)\b", end=r"(?=[;{])|(?<=[;])", return_begin=True, keywords=words("sub method"), relevance=5, contains=[Mode(scope="keyword", match=r"\b(?:sub|method)\b", relevance=0), Mode(scope="title", match=name, relevance=0), Mode(match=r"\([^()]*\)", relevance=0), traits])
    kind = Mode(scope="class", begin=r"\bclass\b(?=\s+[A-Za-z_])", end=r"(?=[;{])", return_begin=True, relevance=5, contains=[Mode(scope="keyword", match=r"\bclass\b", relevance=0), Mode(match="::", relevance=0), Mode(scope="attr", match=r" :\w+(?:\([^()\n]*\))?(?: :\w+(?:\([^()\n]*\))?)*", relevance=1), Mode(scope="title", match=name, relevance=0)])
    declared = Mode(begin=(r"\bfield", r"\s+"), begin_scope={1: "keyword"}, end=r"(?=[;=\n])", relevance=6, contains=[Mode(scope="variable", begin=r"[$@%]\w+", end=r"(?=\s*[;=\n])", relevance=0, contains=[traits])])
    hole.contains = [*texts, plain, numeric]
    pod = comment(r"^=[a-z]\w*", r"^=cut\b.*", relevance=5)
    return Language("perl", Mode(keywords=keywords, contains=[plain, hash_comment(), pod, Mode(match=r"->\s*\{?\w+\}?", relevance=0), sub, kind, declared, *patterns, *texts, numeric, Mode(match=r"-\w\b", relevance=0), Mode(scope="comment", begin=r"^__(?:END|DATA)__$", end=r"\Z(?!\n)")]), ("pl", "pm"))


def vim() -> Language:
    """Vim script by usr_41 and the lists of commands and functions."""
    # Commands, in full and as they are mostly cut short; functions.
    commands = """
    Next abbreviate append args augroup autocmd badd bdelete behave bfirst blast bnext bprevious break breakadd browse buffer buffers bufdo bwipeout call catch cclose
    cd change checktime clast close cmap cnext cnoremap colorscheme command compiler conf confirm continue copen cprevious cunmap delcommand delete delfunction
    delmarks diffoff diffthis display doautocmd edit else elseif elsei emenu endif endfor endfunction endf endtry endt endwhile endw enew execute exe exit file filetype
    finally fin finish fini fold for fu function global goto grep help hi highlight history if iabbrev imap inoremap iunmap join jumps keepjumps language later lcd let
    lmap lnext lockvar lopen ls make map mapclear marks match menu mkview mode move new nmap nnoremap noautocmd nohlsearch noremap normal norm nunmap omap on only onoremap
    open options packadd perl pop popup print profile put pwd python python3 quit quitall qall read redo redir redraw register resize return retab ruby runtime set setf
    setfiletype setglobal setlocal setl shell sign silent sleep sort source spellgood split sp startinsert stop stopinsert substitute suspend syntax syn tab tabclose tabedit
    tabnew tabnext tabprevious tag tags throw tn topleft tr try undo unlet unmap update verbose version vertical vglobal view vimgrep visual vmap vnew vnoremap vsplit vs
    wall while wincmd wnext wq wqa write x xall xmap xnoremap yank
    """
    functions = """
    abs acos add append argc argv asin atan browse bufexists buflisted bufloaded bufname bufnr bufwinnr byte2line ceil changenr char2nr cindent col complete confirm copy
    cos count cursor deepcopy delete did_filetype empty escape eval eventhandler executable exists expand extend feedkeys filereadable filewritable filter finddir
    findfile float2nr floor fmod fnameescape fnamemodify foldclosed foldlevel foreground garbagecollect get getbufvar getchar getcmdline getcmdpos getcwd getfperm
    getfsize getftime getftype getline getloclist getmatches getpid getpos getqflist getreg getregtype gettabvar getwinposx getwinvar glob globpath has has_key
    hasmapto histadd histget hlID iconv indent index input inputlist insert invert isdirectory items join keys len line line2byte localtime log map maparg
    mapcheck match matchadd matchend matchlist matchstr max min mkdir mode nr2char pathshorten pow prevnonblank printf pumvisible range readfile reltime remove rename
    repeat resolve reverse round search searchpair searchpos server2client setbufvar setcmdpos setline setloclist setpos setqflist setreg settabvar setwinvar sha256
    shellescape sin sort spellbadword split sqrt str2float str2nr strchars strftime stridx string strlen strpart strridx strtrans submatch synID system tabpagenr
    taglist tan tempname tolower toupper tr trunc type undofile values virtcol winbufnr wincol winheight winline winnr winwidth writefile xor
    """
    name = r"[a-zA-Z_]\w*"
    scoped = Mode(scope="variable", match=r"\b[bwglsatv]:[\w\d_]+|&(?:[lg]:)?\w+|@[\w\"]")
    title = Mode(scope="title", match=rf"(?:[sgal]:|<SID>)?[A-Za-z_][\w.#]*", relevance=0)
    function = Mode(begin=r"\bfu(?:n(?:c(?:t(?:i(?:on?)?)?)?)?)?!?(?=\s+(?:[sgal]:|<SID>)?[A-Za-z_][\w.#]*\s*\()", end="$", return_begin=True, relevance=0, contains=[Mode(scope="keyword", match=r"\bfu[a-z]*!?", relevance=0), Mode(scope="params", begin=r"\(", end=r"\)", relevance=1), title])
    return Language(
        "vim",
        Mode(
            keywords=words(commands, pattern=r"[a-zA-Z]\w*", built_in=functions),
            illegal=";",
            contains=[
                number(r"\b(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?)\b"),
                Mode(scope="string", begin="'", end="'", illegal=r"\n"),
                # a quote opens a text if another closes it, on this line or one that goes on; else a comment
                Mode(scope="string", match=r'"(?:\\"|\n\\|[^"\n])*"'),
                comment('"', "$"),
                scoped,
                function,
                Mode(scope="symbol", match=r"<[\w-]+>", relevance=1),
            ],
        ),
    )


def basic() -> Language:
    """Line-numbered BASIC by the GW-BASIC manual."""
    # Statements and functions of the manual.
    listed = "ABS ASC AND ATN AUTO BEEP BLOAD BSAVE CALL CALLS CDBL CHAIN CHDIR CHR$ CINT CIRCLE CLEAR CLOSE CLS COLOR COM COMMON CONT COS CSNG CSRLIN CVD CVI CVS DATA DATE$ DEFDBL DEFINT DEFSNG DEFSTR DEF SEG USR DELETE DIM DRAW EDIT END ENVIRON ENVIRON$ EOF EQV ERASE ERDEV ERDEV$ ERL ERR ERROR EXP FIELD FILES FIX FOR NEXT FRE GET GOSUB GOTO HEX$ IF THEN ELSE INKEY$ INP INPUT INPUT# INPUT$ INSTR IMP INT IOCTL IOCTL$ KEY ON OFF LIST KILL LEFT$ LEN LET LINE LLIST LOAD LOC LOCATE LOF LOG LPRINT LSET MERGE MID$ MKDIR MKD$ MKI$ MKS$ MOD NAME NEW NOISE NOT OCT$ OR PEN PLAY OPEN OPTION BASE OUT PAINT PALETTE PCOPY PEEK PMAP POINT POKE POS PRINT PRINT# PSET PRESET PUT RANDOMIZE READ REM RENUM RESET RESTORE RESUME RETURN RIGHT$ RMDIR RND RSET RUN SAVE SCREEN SGN SHELL SIN SOUND SPACE$ SPC SQR STEP STICK STOP STR$ STRIG STRING$ SWAP SYSTEM TAB TAN TIME$ TIMER TROFF TRON TO USING VAL VARPTR VARPTR$ VIEW WAIT WHILE WEND WIDTH WINDOW WRITE XOR"
    return Language(
        "basic",
        Mode(
            keywords=words(listed, pattern=r"[a-zA-Z][a-zA-Z0-9_$%!#]*"),
            illegal=r"^\.",
            contains=[
                Mode(scope="string", match=r'"[^"\n]*"?'),
                comment(r"\bREM\b", "$", relevance=10),
                comment("'", "$", relevance=0),
                Mode(scope="symbol", match=r"^\d+[ \t]", relevance=10),
                Mode(scope="number", match=r"\b\d+(?:\.\d*)?(?:[eEdD][-+]?\d+)?[!#%&]?|(?<!\w)\.\d+(?:[eEdD][-+]?\d+)?[!#]?", relevance=0),
                Mode(scope="number", match=r"&[hH][0-9a-fA-F]{1,4}|&[oO]?[0-7]{1,6}"),
            ],
        ),
        case_insensitive=True,
    )


# Elements of HTML and SVG that style sheets name most.
ELEMENTS = "a abbr address article aside audio b blockquote body button canvas caption cite code dd del details dfn div dl dt em fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html i iframe img input ins kbd label legend li main mark menu nav object ol optgroup option p picture q quote samp section select source span strong summary sup table tbody td textarea tfoot th thead time tr ul var video circle g line path polygon rect svg text"
UNIT = r"(?:%|em|ex|ch|rem|vw|vh|vmin|vmax|cm|mm|in|pt|pc|px|deg|grad|rad|turn|s|ms|Hz|kHz|dpi|dpcm|dppx|fr)?"


class Sheet:
    """Parts that the style languages share."""

    def __init__(self) -> None:
        self.number = number(rf"(?<![\w#.-])-?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][-+]?\d+)?{UNIT}(?![\w-])")
        self.color = Mode(scope="number", match=r"#(?:[0-9a-fA-F]{8}|[0-9a-fA-F]{6}|[0-9a-fA-F]{3,4})\b", relevance=0)
        self.texts = [single(), double()]
        self.remarks = [block_comment(), line_comment()]
        self.important = Mode(scope="meta", match=r"!\s*(?:important|default|global|optional)", relevance=0)
        self.function = Mode(scope="built_in", match=r"[\w-]+(?=\()", relevance=0)
        self.address = Mode(match=(r"\burl", r"\(", r"[^()'\"\s]+", r"\)"), scope={1: "built_in", 3: "string"}, relevance=0)
        self.selectors = [
            Mode(scope="selector-id", match=r"#[A-Za-z_][\w-]*", relevance=0),
            Mode(scope="selector-class", match=r"\.-?[A-Za-z_][\w-]*", relevance=0),
            Mode(scope="selector-attr", begin=r"\[", end=r"\]", illegal="$", contains=self.texts),
            Mode(scope="selector-pseudo", match=r"::?[a-z][a-z-]*(?:\([^()]*\))?"),
            Mode(scope="selector-tag", match=rf"(?<![\w.#$@-])(?:{'|'.join(sorted(ELEMENTS.split(), key=len, reverse=True))})(?![\w-])(?!\s*:\s)", relevance=1),
        ]

    def values(self, *more: Mode) -> list[Mode]:
        return [*self.remarks, *more, *self.texts, self.color, self.number, self.important, self.address, self.function]


def scss() -> Language:
    """Sass in its SCSS syntax (sass-lang.com): declarations of a rule, nested rules, variables, directives."""
    s = Sheet()
    variable = Mode(scope="variable", match=r"\$[A-Za-z_-][\w-]*")
    hole = Mode(begin=r"#\{", end=r"\}", relevance=0, contains=[variable, s.number, *s.texts])
    values = s.values(variable, hole)
    declaration = Mode(begin=(r"(?<![\w$-])-?[a-z][a-z-]*(?:#\{[^}\n]*\}[a-z-]*)*", r"\s*", r":(?=[\s\d#$'\"(-])"), begin_scope={1: "attribute"}, end=r"[;{}]", return_end=True, relevance=0, contains=values)
    directive = Mode(begin=r"(?=@)", end=r"[{;]", relevance=0, keywords=words("and or not only", pattern=r"[a-z-]+", attribute="min-width max-width min-height max-height orientation"), contains=[Mode(scope="keyword", match=r"@[a-z-]+"), *values])
    return Language(
        "scss",
        Mode(illegal="[=/|']", contains=[*s.remarks, Mode(scope="attr", match=r"--[A-Za-z_][\w-]*(?=\s*:)"), directive, Mode(begin=(r"\$[A-Za-z_-][\w-]*", r"\s*", ":"), begin_scope={1: "variable"}, end=r"[;}]", relevance=1, contains=values), declaration, hole, *s.selectors, Mode(scope="selector-tag", match="&", relevance=0), variable, s.important]),
        case_insensitive=True,
    )


def less() -> Language:
    """Less (lesscss.org): variables after @, mixins called by their class, guards, escaped texts."""
    s = Sheet()
    hole = Mode(scope="variable", match=r"@\{[\w-]+\}", relevance=1)
    variable = Mode(scope="variable", match=r"@@?[\w-]+", relevance=1)
    escaped = Mode(scope="string", match=r"~(?:\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`)", relevance=1)
    values = s.values(escaped, hole, variable)
    declaration = Mode(begin=(r"(?<![\w@-])-?[a-z][a-z-]*(?:@\{[\w-]+\}[a-z-]*)*", r"\s*", r"\+?_?:(?=[\s\d#@~'\"(-])"), begin_scope={1: "attribute"}, end=r"[;{}]", return_end=True, relevance=1, contains=values)
    directive = Mode(begin=r"(?=@(?:media|import|plugin|charset|font-face|keyframes|supports|namespace|page|-[a-z]+-)[\w-]*)", end=r"[{;]", relevance=0, keywords=words("and or not only", pattern=r"[a-z-]+"), contains=[Mode(scope="keyword", match=r"@[a-z-]+", relevance=1), *values])
    assigned = Mode(begin=(r"@[\w-]+", r"\s*", ":"), begin_scope={1: "variable"}, end=r"[;}]", relevance=2, contains=values)
    guard = Mode(begin=r"\bwhen\b", end=r"(?=[{;])", relevance=1, keywords=words("when and not or", built_in="default"), contains=values)
    ids = [Mode(scope="selector-id", match=r"#[A-Za-z_][\w-]*", relevance=1), *s.selectors[1:]]
    return Language("less", Mode(illegal=r"[=$]", contains=[*s.remarks, directive, assigned, variable, hole, declaration, guard, Mode(scope="selector-tag", match="&", relevance=0), *ids]), case_insensitive=True)


def stylus() -> Language:
    """Stylus (stylus-lang.com): blocks by indentation; colons, semicolons and braces may go."""
    s = Sheet()
    variable = Mode(scope="variable", match=r"\$[A-Za-z_][\w-]*")
    values = s.values(variable)
    names = r"-?[a-z][a-z-]*"
    property_ = Mode(begin=(r"^[ \t]+", rf"{names}(?=(?::[ \t]|[ \t]+)[\w#$'\"(.-])(?![ \t]+[=?])", r":?[ \t]+"), begin_scope={2: "attribute"}, end=r"$|(?=[;{}])", relevance=0, contains=values)
    directives = "charset css debug extend font-face for if import include keyframes media mixin page warn while else unless return in not is isnt and or null true false"
    return Language(
        "stylus",
        Mode(
            illegal=r"\?|^return\b|^\s*elif\b|//.*;$|^\s*var\b",
            contains=[
                *s.remarks,
                Mode(scope="keyword", match=r"@[a-z-]+|^[ \t]*(?:if|else|unless|for|return)\b"),
                Mode(begin=(r"^[ \t]*", r"\$?[A-Za-z_][\w-]*", r"\s*[?:]?=(?!=)"), begin_scope={2: "variable"}, end="$", relevance=0, contains=values),
                Mode(scope="function", begin=r"^[ \t]*(?=[A-Za-z_][\w-]*\([^()\n]*\)[ \t]*$)", end="$", relevance=0, contains=[Mode(scope="title", match=r"[A-Za-z_][\w-]*(?=\()"), Mode(scope="params", begin=r"\(", end=r"\)", contains=values)]),
                *s.selectors,
                Mode(scope="selector-tag", match="&", relevance=0),
                property_,
                *values,
            ],
            keywords=words(directives, pattern=r"[a-z-]+"),
        ),
        ("styl",),
    )
