"""Lexers and grammars of the languages whose syntax is checked.

Terminals in parentheses or braces stand for a whole bracketed group, named by what its inside is valid as. STR, NUM and ID
are literals and names; a word is also its own terminal.
"""

from __future__ import annotations

import re

from .chart import Grammar

# Reserved words: fixed values of the languages.
JS_WORDS = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
JAVA_WORDS = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
KT_WORDS = frozenset("as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while".split())
PY_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())

_CONFLICT = r"^(?:<{7}|={7}|>{7}|\|{7})(?:[ \t][^\n]*)?$"
_NUMBER = r"(?:0[xX][0-9a-fA-F_]+[lLuUn]*|0[bB][01_]+[lLuUn]*|0[oO][0-7_]+n?|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDlLuUjJn]*)"

_C_TOKENS = r"""
(?P<nl>\n)|(?P<ws>[ \t\r\f\v﻿ ]+)|(?P<conflict>{conflict})|(?P<comment>//[^\n]*|/\*(?s:.*?)\*/)
|(?P<str>{strings})|(?P<num>{number})|(?P<id>{ident})|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<op>{ops})|(?P<ill>.)
"""


def _lexer(strings: str, ops: str, ident: str = r"[^\W\d][\w$]*|\$[\w$]*|_[\w$]*", number: str = _NUMBER) -> re.Pattern[str]:
    return re.compile(_C_TOKENS.replace("\n", "").format(conflict=_CONFLICT, strings=strings, number=number, ident=ident, ops=ops), re.M)


_DQ, _SQ = r'"(?:[^"\\\n]|\\(?:\r\n|(?s:.)))*"', r"'(?:[^'\\\n]|\\(?:\r\n|(?s:.)))*'"
# templates without fields; the parser reads those with fields, and regular expressions, where one may stand
_TEMPLATE = r"`(?:[^`\\$]|\\(?s:.)|\$(?!\{))*`"
JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
JS_CHUNK = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*")
JS_LEX = _lexer(f"{_DQ}|{_SQ}|{_TEMPLATE}", r"\.\.\.|=>|\*\*=|<<=|===|!==|&&=|\|\|=|\?\?=|\?\.(?!\d)|\*\*|&&|\|\||\?\?|\+\+|--|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^!~<>=?:;,.@#`]", r"#?(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4})*")
JAVA_LEX = _lexer(rf'"""(?s:(?:[^\\]|\\.)*?)"""|(?!""")(?:{_DQ})|{_SQ}', r"\.\.\.|->|::|<<=|&&|\|\||\+\+|--|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^!~<>=?:;,.@]")
_KT_DQ = r'"(?:[^"\\\n$]|\\.|\$(?!\{)|\$\{(?:[^{}"\n]|"(?:[^"\\\n]|\\.)*"|\{[^{}\n]*\})*\})*"'
KT_LEX = _lexer(rf'"""(?s:.*?)"""+|(?!""")(?:{_KT_DQ})|\'(?:[^\'\\\n]|\\.[0-9a-fA-F]*)\'', r"\.\.<|\.\.|->|::|\?\.|\?:|!!|&&|\|\||\+\+|--|===|!==|==|!=|<=|>=|\+=|-=|\*=|/=|%=|[-+*/%!<>=?:;,.@]", r"`[^`\n]+`|[^\W\d]\w*|_\w*", r"(?:0[xX][0-9a-fA-F_]+[uUL]*|0[bB][01_]+[uUL]*|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[fFLuU]*)")
_PFX = r"(?:[rRbBuUfF]{1,2})?"
_PY_DIGITS = r"\d(?:_?\d)*"
_PY_NUMBER = rf"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:{_PY_DIGITS}\.(?:{_PY_DIGITS})?|\.{_PY_DIGITS})(?:[eE][+-]?{_PY_DIGITS})?[jJ]?|{_PY_DIGITS}(?:[eE][+-]?{_PY_DIGITS}[jJ]?|[jJ])|(?:[1-9](?:_?\d)*|0(?:_?0)*)(?!\d))"
# a formatted string whose fields hold strings of their own; others are read like any string
_PY_FIELD = r"\{(?:[^{}\"'\n]|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}\n]*\})*\}"
_PY_FORMAT = rf"(?:[fF][rR]?|[rR][fF])(?!\"{{3}}|'{{3}})(?:\"(?:[^\"\\\n{{}}]|\\(?s:.)|\{{\{{|\}}\}}|{_PY_FIELD})*\"|'(?:[^'\\\n{{}}]|\\(?s:.)|\{{\{{|\}}\}}|{_PY_FIELD})*')"
PY_LEX = re.compile(
    (r"""(?P<nl>\n)|(?P<ws>[ \t\r\f﻿]+|\\\r?\n)|(?P<conflict>{conflict})|(?P<comment>\#[^\n]*)"""
     r"""|(?P<str>{format}|{p}(?:\"\"\"(?s:(?:[^\\]|\\.)*?)\"\"\"|'''(?s:(?:[^\\]|\\.)*?)'''|(?!\"\"\"|''')(?:\"(?:[^\"\\\n]|\\(?s:.))*\"|'(?:[^'\\\n]|\\(?s:.))*')))"""
     r"""|(?P<num>{number})|(?P<id>[^\W\d](?:\w|[\u0300-\u036f\ufe00-\ufe0f\U000e0100-\U000e01ef])*)|(?P<open>[(\[{{])|(?P<close>[)\]}}])"""
     r"""|(?P<op>\.\.\.|\*\*=|//=|>>=|<<=|\*\*|//|>>|<<|<=|>=|==|!=|->|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|:=|[-+*/%@&|^~<>=.,:;])|(?P<ill>.)""").format(conflict=_CONFLICT, p=_PFX, number=_PY_NUMBER, format=_PY_FORMAT), re.M)  # fmt: skip
JSON_LEX = re.compile(
    rf"""(?P<nl>\n)|(?P<ws>[ \t\r]+)|(?P<conflict>{_CONFLICT})|(?P<str>"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{{4}})*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<id>[A-Za-z_]\w*)|(?P<open>[\[{{])|(?P<close>[\]}}])|(?P<op>[:,])|(?P<ill>.)""", re.M)

_JS = """
# statements
Stmt: Expr | ; | {b} | const CBinds | VarWord1 Binds | if (e) Stmt | if (e) Stmt else Stmt | for await? (for) Stmt | while (e) Stmt | do Stmt while (e)
| return Expr? | return Seq | throw Expr | throw Seq | break ID? | continue ID? | debugger | switch (e) {sw} | ID : Stmt | try {b} Catch | try {b} Catch? finally {b}
| Func | ClassDecl | ImportDecl | ExportDecl | Seq
Seq: Expr , Expr | Seq , Expr
# with a semicolon behind it, which may stand for an empty statement; and what ends with its block
# clauses of a statement that was divided before them
StmtP: Stmt | else Stmt | Catch | finally {b}
StmtS: StmtP | do | do Stmt | else | else Empty | Empty
Empty: if (e) Empty? | if (e) Stmt else Empty? | for await? (for) Empty? | while (e) Empty? | ID : Empty?
StmtB: {b} | if (e) StmtB | if (e) Stmt else StmtB | for await? (for) StmtB | while (e) StmtB | switch (e) {sw} | ID : StmtB | try {b} Catch | try {b} Catch? finally {b} | Func | ClassDecl
StmtC: StmtB | else StmtB | Catch | finally {b}
| export Func | Deco* export ClassDecl | export default ClassExpr | export default FuncExpr | Deco* export default ClassExpr
MemberB: Deco* Mod* MethMod* PropName QM? TParams? (p) Ann? {b} | static {b}
CaseS: case Expr : CaseS? | case Seq : CaseS? | default : CaseS? | StmtS
CaseB: case Expr : CaseB | case Seq : CaseB | default : CaseB | StmtC
Closed: StmtC | MemberB | CaseB
Typed: Member | TMember
Whole: Stmt | Member | TMember | CaseB | Case
DoHead: do {b}
DoWhile: do Stmt while (e)
Decos: Deco | Decos Deco
Catch: catch (p)? {b}
VarWord: const | VarWord1
VarWord1: let | var | using | await using
CBinds: CBind | CBinds , CBind
CBind: Pat Ann? = Expr
Binds: Bind | Binds , Bind
Bind: Pat Ann? | Pat Ann? = Expr
Pat: ID | {o} | [a]
Func: async? function STAR? ID TParams? (p) Ann? {b}
FuncExpr: async? function STAR? ID? TParams? (p) Ann? {b}
ClassDecl: Deco* abstract? class ID TParams? Ext? Impl? {c}
ClassExpr: Deco* abstract? class ID? TParams? Ext? Impl? {c}
Ext: extends Post TArgs?
Deco: @ DecoName TArgs? | @ DecoName TArgs? (a) | @ (e)
DecoName: ID | DecoName . Name | DecoName (a)
ImportDecl: import STR With? | import type? Imports from STR With?
With: with {o} | assert {o}
Imports: ID | {im} | STAR as ID | ID , {im} | ID , STAR as ID
ExportDecl: export {im} | export {im} from STR With? | export STAR from STR With? | export STAR as Name from STR With? | export STAR as STR from STR With? | export default Expr | export default ClassExpr | export default FuncExpr | export VarWord Binds | export Func | export ClassDecl | Deco* export ClassDecl | Deco* export default ClassExpr
Case: case Expr : Case? | case Seq : Case? | default : Case? | StmtP
# class members, object members
Member: ; | Deco | Deco* Mod* PropName QM? Ann? | Deco* Mod* PropName Ann? = Expr | Deco* Mod* MethMod* PropName QM? TParams? (p) Ann? {b} | static {b}
MethMod: get | set | async | STAR
Mod: static | accessor
PropName: Name | STR | NUM | [e]
Prop: ID | PropName : Expr | ... Expr | MethMod* PropName TParams? (p) Ann? {b} | ID = Expr
Import1: Name | Name as Name | STR as Name | Name as STR | STR | STR as STR
Elem: Expr | ... Expr
# parameters
Param: Deco* ...? Pat Ann? | Deco* Pat Ann? = Expr
ForHead: ForInit? ; ForExpr? ; ForExpr? | VarWord Pat Ann? of Expr | VarWord Pat in ForExpr | Post of Expr | Post in ForExpr
ForInit: VarWord Binds | ForExpr
ForExpr: Expr | Seq
# expressions
Expr: Un | Un Bin Expr | Un NULLISH Expr | Un QM Expr : Expr | Arrow | yield STAR? Expr? | Un Assign Expr
Arrow: async? ID => Body | async? TParams? (p) Ann? => Body
Body: Expr | {b}
Bin: + | - | STAR | / | % | POW | == | != | === | !== | < | > | <= | >= | && | || | & | ^ | << | > > | > > > | in | instanceof | PIPE
Assign: = | += | -= | *= | /= | %= | **= | <<= | &= | |= | ^= | &&= | ||= | ??= | > >= | > > >=
Un: Pre Un | Post | Post ++ | Post --
Pre: ! | ~ | + | - | typeof | void | delete | await | ++ | --
Post: Prim | Post . Name | Post ?. Name | Post ?. (a) | Post ?. [e] | Post (a) | Post [e] | Post TPL | new Post | new . target | import (a) | import . Name
Prim: ID | STR | NUM | TPL | this | super | null | true | false | (e) | [a] | {o} | FuncExpr | ClassExpr | JSX
Name: ID | WORD
"""
_TS_MORE = """
Stmt: Decl | declare Decl1 | Post TArgs (a)
ExportDecl: export Decl | export declare Decl1 | export type {im} | export type {im} from STR With? | export type STAR from STR With? | export type STAR as Name from STR With? | export = Expr | export as namespace ID | export import ID = Entity | export default interface ID TParams? IExt? {t} | export default async? function STAR? ID? TParams? (p) Ann?
ImportDecl: import type? ID = Entity
Entity: Dotted | ID (a)
StmtB: export? declare? interface ID TParams? IExt? {t} | export? declare? const? enum ID {en} | export? declare? namespace Dotted {b} | export? declare? module Dotted {b} | declare module STR {b} | declare global {b} | export? declare ClassDecl
Decl: interface ID TParams? IExt? {t} | type ID TParams? = Type | const? enum ID {en} | namespace Dotted {b} | module Dotted {b} | global {b} | async? function STAR? ID TParams? (p) Ann?
Decl1: Decl | VarWord Binds | ClassDecl | Func | module STR {b}?
IExt: extends Types
Impl: implements Types
Types: Type | Types , Type
Dotted: ID | Dotted . ID
Bind: Pat ! Ann
CBind: Pat Ann
Ann: : Type | : Asserts
Asserts: ID is Type | this is Type | asserts ID | asserts this | asserts ID is Type | asserts this is Type
TParams: < TParam1 ,? >
TParam1: TParam | TParam1 , TParam
TMod: const | in | out
TParam: TMod* ID | TMod* ID extends Type | TMod* ID = Type | TMod* ID extends Type = Type
TArgs: < Types ,? >
Type: Union | Union extends Type QM Type : Type | FType
FType: (p) => Ret | TParams (p) => Ret | abstract? new TParams? (p) => Type
Ret: Type | Asserts
Union: Inter | Union PIPE Inter | PIPE Inter | PIPE FType | Union PIPE FType
Inter: Type1 | Inter & Type1 | & Type1
Type1: [] | TypeName | TypeName TArgs | STR | NUM | - NUM | TPL | {t} | [ty] | (ty) | Type1 [] | Type1 [ty] | typeof TypeName TArgs? | typeof import (a) TArgs? | keyof Type1 | readonly Type1 | unique Type1 | infer ID | infer ID extends Type1 | this | null | void | true | false | import (a) TArgs? | typeof import (a) . TName TArgs? | import (a) . TName TArgs?
TName: Name | TName . Name
TypeName: ID | TypeName . Name | this | this . Name
TElem: Type | Type QM | ... Type | Name : Type | Name QM : Type | ... Name : Type
TMember: ; | Sign* PropName QM? Ann? | get PropName (p) Ann? | set PropName (p) Ann? | PropName QM? TParams? (p) Ann? | TParams? (p) Ann? | new TParams? (p) Ann? | Sign* [ix] Ann | Sign* [mp] Opt? Ann?
Sign: readonly | + | -
Opt: QM | + QM | - QM
Index: ID : Type
Mapped: ID in Type | ID in Type as Type
Mod: public | private | protected | readonly | abstract | override | declare
Member: Deco* Mod* PropName QM Ann? = Expr | Deco* Mod* MethMod* PropName QM? TParams? (p) Ann? | Deco* Mod* PropName ! Ann | Deco* Mod* [ix] Ann
PMod: public | private | protected | readonly | override
Param: Deco* PMod* Pat QM Ann? | Deco* PMod* ...? Pat Ann? | Deco* PMod* Pat Ann? = Expr | this Ann
Enum1: Name | STR | [e] | Name = Expr | STR = Expr | [e] = Expr
Expr: Expr as Type | Expr satisfies Type | Expr as const | Expr as const satisfies Type
Un: TArgs Un | < const > Un
Post: Post ! | Post TArgs (a) | new Post TArgs (a) | Post ?. TArgs (a) | Post TArgs TPL | Post TArgs | Post ! [e]
Post: new Post TArgs
Import1: type Name | type Name as Name
"""
_JAVA = """
Top: ; | package Dotted | Anno* package Dotted | import static? Dotted | import static? Dotted . STAR | TypeDecl | Anno
TypeDecl: JMod* class ID TParams? JExt? JImpl? Permits? {c} | JMod* interface ID TParams? IExt? Permits? {c} | JMod* enum ID JImpl? {jen} | JMod* record ID TParams? (jp) JImpl? {c} | JMod* @ interface ID {c}
JMod: Anno | public | private | protected | static | final | abstract | native | synchronized | transient | volatile | strictfp | default | sealed | non - sealed
JExt: extends Type
JImpl: implements Types
IExt: extends Types
Permits: permits Types
Types: Type | Types , Type
Dotted: ID | Dotted . ID
Anno: @ Dotted | @ Dotted (an)
AnnoArg: Expr | ID = Expr | ID = {ai} | {ai} | Anno | ID = Anno
TParams: < TParam1 >
TParam1: TParam | TParam1 , TParam
TParam: Anno* ID | Anno* ID extends Type | TParam & Type
Type: Basic | CType | Type [] | Anno Type
Basic: int | long | short | byte | char | boolean | float | double | void
CType: ID | ID TArgs | CType . ID | CType . ID TArgs
TArgs: < TArg1 >
TArg1: TArg | TArg1 , TArg
TArg: Type | QM | QM extends Type | QM super Type | Anno TArg
Member: ; | TypeDecl | JMod* {b} | JMod* TParams? Type ID (jp) []? Throws? MBody? | JMod* TParams? Type ID (jp) Throws? MBody? | JMod* TParams? ID (jp) Throws? {b} | JMod* ID {b} | JMod* Type JBinds | Anno
MBody: {b} | default Expr
Throws: throws Types
JBinds: JBind | JBinds , JBind
JBind: ID | ID [] | ID = Init | ID [] = Init
Init: Expr | {ai}
JParam: JMod* Type ID | JMod* Type ID [] | JMod* Type ... ID | JMod* Type this
Stmt: ; | {b} | JMod* Type JBinds | StmtExpr | if (e) Stmt | if (e) Stmt else Stmt | for (jfor) Stmt | while (e) Stmt | do Stmt while (e)
| return Expr? | throw Expr | break ID? | continue ID? | yield Expr | switch (e) {sw} | synchronized (e) {b} | assert Expr | assert Expr : Expr | ID : Stmt | try (res)? {b} Catch* | try (res)? {b} Catch* finally {b} | TypeDecl | Anno
StmtP: Stmt | else Stmt
StmtS: StmtP | do | do Stmt | else | else Empty | Empty
Empty: if (e) Empty? | if (e) Stmt else Empty? | for (jfor) Empty? | while (e) Empty? | ID : Empty?
StmtC: StmtB | else StmtB
StmtB: {b} | if (e) StmtB | if (e) Stmt else StmtB | for (jfor) StmtB | while (e) StmtB | switch (e) {sw} | synchronized (e) {b} | ID : StmtB | try (res)? {b} Catch* | try (res)? {b} Catch* finally {b} | TypeDecl | do StmtB
TopB: TypeDecl
MemberB: TypeDecl | JMod* {b} | JMod* TParams? Type ID (jp) []? Throws? {b} | JMod* TParams? ID (jp) Throws? {b} | JMod* ID {b}
CaseB: case Exprs : CaseB? | default : CaseB? | case Exprs -> {b} | default -> {b} | StmtC
Catch: catch (cp) {b}
CatchParam: JMod* CTypes ID
CTypes: CType | CTypes PIPE CType
StmtExpr: Post Assign Expr | Post ++ | Post -- | ++ Post | -- Post | Post (a) | new Post | super (a) | this (a) | Post . TArgs ID (a) | new Post {c} | switch (e) {sw}
Case: case Exprs : Case? | default : Case? | case Exprs -> Stmt | default -> Stmt | case Exprs -> Expr | default -> Expr | StmtS
Exprs: Pattern | Exprs , Pattern
Pattern: Expr | CType ID | Pattern when Expr | CType (pat)
EnumConst: Anno* ID | Anno* ID (a) | Anno* ID (a)? {c}
Res: JMod* Type ID = Expr | Post
ForHead: ForInit? ; Expr? ; ForUpd? | JMod* Type ID : Expr
ForInit: JMod* Type JBinds | ForUpd
ForUpd: Expr | ForUpd , Expr
Elem: Expr
AInit: Init
InstOf: Un instanceof JMod* Type | Un instanceof JMod* CType ID | Un instanceof CType (pat) | Un Bin InstOf
Expr: Un | Un Bin Expr | Un QM Expr : Expr | Un Assign Expr | InstOf | InstOf QM Expr : Expr | InstOf Logic Expr | Lambda
Logic: && | || | == | !=
Lambda: ID -> Body | (lp) -> Body
Body: Expr | {b}
LParam: ID | JParam
Bin: + | - | STAR | / | % | == | != | < | > | <= | >= | && | || | & | ^ | << | > > | > > > | PIPE
Assign: = | += | -= | *= | /= | %= | <<= | &= | |= | ^= | > >= | > > >=
Un: Pre Un | Post | Post ++ | Post -- | (cast) Un | (cast) Lambda | switch (e) {sw}
Pre: ! | ~ | + | - | ++ | --
Post: Prim | Post . ID | Post . this | Post . class | Post . new Post | Post . super | Post . TArgs ID (a) | Post (a) | Post [e] | Post :: ID | Post :: new | Type :: ID | Type :: new | new NewType (a) | new NewType (a) {c} | new CType < > (a) | new CType < > (a) {c} | new NewType Dim1 | new NewType Dim0 {ai} | Type . class
NewType: Basic | CType
Dim1: [e] | Dim1 [e] | Dim1 []
Dim0: [] | Dim0 []
Prim: ID | STR | NUM | this | super | null | true | false | (e)
"""
_KT = """
Top: package Dotted | import Dotted | import Dotted . STAR | import Dotted as ID | Decl | Anno | Anno KMod* | ;
Dotted: ID | Dotted . ID
Anno: @ Dotted TArgs? | @ Dotted TArgs? (a) | @ ID : Dotted | @ ID : Dotted (a)
KMod: Anno | public | private | protected | internal | open | abstract | final | sealed | data | override | suspend | inline | lateinit | const | companion | operator | infix | tailrec | external | value | annotation | enum | inner | expect | actual | crossinline | noinline | reified | vararg | out | in
Decl: KMod* fun TParams? FunName (kp) Ret? Where? FunBody? | KMod* val TParams? VarName Ret? PInit? | KMod* var TParams? VarName Ret? PInit? | KMod* class ID TParams? Ctor? Supers? Where? {c}? | KMod* interface ID TParams? Supers? {c}? | KMod* object ID? Supers? {c}? | typealias ID TParams? = Type | KMod* constructor (kp) {b}? | KMod* constructor (kp) : this (a) {b}? | KMod* constructor (kp) : super (a) {b}? | init {b} | Acc
Acc: KMod* get | KMod* set | KMod* get () Ret? FunBody | KMod* set (kp) FunBody
FunName: ID | Type . ID
VarName: ID | (dp) | Type . ID
Ret: : Type
FunBody: {b} | = Stmt
PInit: = Stmt | by Expr
Ctor: KMod* (kp) | KMod* constructor (kp)
Supers: : Super1
Super1: Super | Super1 , Super
Super: Type | Type (a) | Type by Expr
Where: where ID : Type
TParams: < TParam1 >
TParam1: TParam | TParam1 , TParam
TParam: KMod* ID | KMod* ID : Type
Type: CType | Type QM | (ty) -> Type | suspend (ty) -> Type | CType . (ty) -> Type | (ty) QM | (ty)
CType: ID | ID TArgs | CType . ID | CType . ID TArgs | Anno CType | dynamic
TArgs: < TArg1 >
TArg1: TArg | TArg1 , TArg
TArg: Type | STAR | in Type | out Type
Member: Decl | Anno | KMod* companion object ID? Supers? {c}? | ;
EnumPart: Anno* ID | Anno* ID (a) | Anno* ID (a)? {c} | Member
KParam: KMod* ID : Type | KMod* ID : Type = Expr | KMod* val ID : Type | KMod* var ID : Type | KMod* val ID : Type = Expr | KMod* var ID : Type = Expr | ID
DParam: ID | ID : Type
KType: Type | ID : Type
Stmt: Decl | Expr | ; | Post Assign Stmt | for (kfor) Stmt | while (e) Stmt | do Stmt while (e) | Anno | ID @ Stmt | else Stmt | Catch | finally {b} | Stmt ; Stmt | Stmt ;
Catch: catch (kp) {b}
If: if (e) Stmt | if (e) Stmt else Stmt | if (e) Stmt ; else Stmt
Jump: return Stmt? | return @ ID Stmt? | throw Expr | break | continue | break @ ID | continue @ ID
When: when {w} | when (wh) {w}
Try: try {b} Catch* | try {b} Catch* finally {b}
WhenSubj: Expr | val ID = Expr
WhenArm: Conds -> Stmt | else -> Stmt
Conds: Cond | Conds , Cond
Cond: Expr | in Expr | ! in Expr | is Type | ! is Type
ForHead: ID in Expr | ID : Type in Expr | (dp) in Expr
Elem: Expr | ID = Expr | STAR Expr
Lambda: LParams -> Stmt? | Stmt
LParams: LParam | LParams , LParam
LParam: ID | ID : Type | (dp)
Expr: Un | Un Bin Expr | Un ID Expr | Un as Type | Un as QM Type | Un is Type | Un ! is Type | Expr Bin Expr | Jump | If | When | Try
Bin: + | - | STAR | / | % | == | != | === | !== | < | > | <= | >= | && | || | ?: | .. | ..< | in | ! in
Assign: = | += | -= | *= | /= | %=
Un: Pre Un | Post | Post ++ | Post -- | Anno Un
Pre: ! | + | - | ++ | --
Post: Prim | Post . ID | Post ?. ID | Post . class | Post (a) | Post TArgs (a) | Post (a) {l} | Post TArgs? {l} | Post [a] | Post !! | Post :: ID | Post :: class | :: ID | Post @ ID {l}
Prim: ID | STR | NUM | this | this @ ID | super | super TArgs | null | true | false | (e) | {l} | object Supers? {c} | fun (kp) Ret? FunBody | [a]
"""
_PY = """
Line: Simple | Simple ; | Head | @ Named
Simple: Small | Simple ; Small
Small: Stars | Targets Stars | Targets yield Stars? | Targets yield from Expr | Expr Aug Stars | Expr Aug yield Stars? | Expr : Expr | Expr : Expr = Stars | pass | break | continue | return Stars? | raise | raise Expr | raise Expr from Expr
| del Stars | assert Expr | assert Expr , Expr | global Names | nonlocal Names | import DotNames | from Dots? Dotted import ImpNames | from Dots import ImpNames | yield Stars? | yield from Expr | type ID [tp]? = Expr
Targets: Stars = | Targets Stars =
Aug: += | -= | *= | /= | //= | %= | @= | &= | |= | ^= | >>= | <<= | **=
Names: ID | Names , ID
DotNames: Dotted | Dotted as ID | DotNames , Dotted | DotNames , Dotted as ID
Dotted: ID | Dotted . ID
Dots: . | ... | Dots . | Dots ...
ImpNames: STAR | (im) | Imp1
Imp1: Import1 | Imp1 , Import1
Import1: ID | ID as ID
Head: Head1 : | Head1 : Simple | Head1 : Simple ;
Head1: async? def ID (p) | async? def ID [tp] (p) | async? def ID [tp]? (p) -> Expr | class ID | class ID (a) | class ID [tp] | class ID [tp] (a) | if Named | elif Named | else | while Named | async? for Stars in Stars | try | except | except STAR Expr | except STAR Expr as ID | except STAR Stars | except Expr | except Expr as ID | except Stars | finally | async? with Withs | async? with (wi) | match Stars | case Pats | case Pats if Named
Withs: With | Withs , With
With: Expr | Expr as Un
Pats: Pat | Pats , Pat | Pats ,
Pat: OrPat | STAR ID | OrPat as ID
OrPat: Pat1 | OrPat PIPE Pat1
Pat1: ID | Pat1 . ID | Pat1 (pt) | Strs | NUM | - NUM | NUM + NUM | NUM - NUM | - NUM + NUM | - NUM - NUM | None | True | False | (pt) | [pt] | [l] | {mp} | {d}
PatArg: Pat | ID = Pat
PatPair: PatKey : Pat | POW ID
PatKey: Pat1
TypeParam: ID | ID : Expr | ID = Expr | ID : Expr = Expr | STAR ID | POW ID | STAR ID = Star | POW ID = Expr
Stars: Star | Stars1 | Stars1 ,
Stars1: Star , Star | Stars1 , Star | Star
Star: Named | STAR Or
Named: Expr | ID := Expr
Expr: Or | Or if Or else Expr | lambda : Expr | lambda LParams : Expr | lambda LParams , : Expr
LParams: Param | LParams , Param
Or: Un | Or BinOp Un
BinOp: or | and | + | - | STAR | / | // | % | @ | POW | << | >> | & | ^ | == | != | < | > | <= | >= | in | not in | is | is not | PIPE
Un: not Un | - Un | + Un | ~ Un | await Un | Post
Post: Prim | Post . ID | Post (a) | Post [a]
Prim: ID | Strs | NUM | None | True | False | ... | (e) | (t) | [l] | {d}
Strs: STR | Strs STR
# parts between commas
Param: ID | ID = Expr | ID : Expr | ID : Expr = Expr | STAR | STAR ID | STAR ID : Star | POW ID | POW ID : Expr | /
Arg: Named | ID = Expr | STAR Expr | POW Expr
Comp1: Named Comp
Sub: Named | STAR Or | Expr? : Expr? : Expr? | Expr? : Expr? | : | : :
Comp: CompFor | Comp CompFor | Comp if Or
CompFor: async? for Stars in Or
Paren: Named | Named Comp | yield Stars? | yield from Expr
Pair: Expr : Expr | POW Or
DictComp: Expr : Expr Comp | Named Comp
"""
_JSON = """
Value: STR | NUM | true | false | null | {o} | [a]
Prop: STR : Value
"""
GRAMMARS = {"js": Grammar(_JS), "ts": Grammar(_JS + _TS_MORE), "java": Grammar(_JAVA), "kt": Grammar(_KT), "py": Grammar(_PY), "json": Grammar(_JSON)}
