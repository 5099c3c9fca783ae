"""Grammars of the languages, over token classes.

Operators that take part in no other rule share a class, since acceptance does not depend on their precedence.
``CLASSES`` names these classes; all other terminals stand for themselves.
"""

JSON = """
Value: Object | Array | STR | NUM | true | false | null
Object: { Pair%, } | { }
Pair: STR : Value
Array: [ Value%, ] | [ ]
"""

PYTHON = """
File: Stmt*
Stmt: Simple N | Simple ; N | If | While | For | Try | With | Def | Class | Match | Decorated | async Def | async For | async With
Simple: Small | Simple ; Small
Small: Exprs | Assign | return Exprs? | raise | raise Test | raise Test from Test | pass | break | continue | del Exprs | assert Test | assert Test , Test | global Name%, | nonlocal Name%, | Import | type Name TParams? = Test
Assign: Targets Rhs | Exprs AUG Rhs | Exprs : Test | Exprs : Test = Rhs
Targets: Exprs = | Targets Exprs =
Rhs: Exprs | Yield
Exprs: StarTest%,, | Yield
StarTest: Named | * Bor
Yield: yield | yield Exprs | yield from Test
Import: import As%, | from Dots? Dotted import * | from Dots? Dotted import From%, | from Dots? Dotted import ( From%,, ) | from Dots import * | from Dots import From%, | from Dots import ( From%,, )
As: Dotted | Dotted as Name
From: Name | Name as Name
Dots: . | ... | Dots . | Dots ...
Dotted: Name | Dotted . Name
Block: Simple N | Simple ; N | N INDENT Stmt+ DEDENT
If: if Named : Block Else?
Else: elif Named : Block Else? | else : Block
Last: else : Block
While: while Named : Block Last?
For: for Target in Exprs : Block Last?
Target: TargetItem%,,
TargetItem: Bor | * Bor
Try: try : Block Except+ Last? Finally? | try : Block Finally
Except: except : Block | except Exprs : Block | except Test as Name : Block | except * Exprs : Block | except * Test as Name : Block
Finally: finally : Block
With: with WithItem%, : Block | with ( WithItem%,, ) : Block
WithItem: Test | Test as TargetItem
Def: def Name TParams? ( Param%,, ) Arrow? : Block | def Name TParams? ( ) Arrow? : Block
Arrow: -> Test
Param: Name | Name : Test | Name = Test | Name : Test = Test | * | * Name | * Name : StarTest | ** Name | ** Name : Test | /
TParams: [ TParam%,, ]
TParam: Name | Name : Test | * Name | ** Name | Name = Test
Class: class Name TParams? : Block | class Name TParams? ( ) : Block | class Name TParams? ( Arg%,, ) : Block
Decorated: @ Named N Decorated | @ Named N Def | @ Named N Class | @ Named N async Def
Match: match Exprs : N INDENT Case+ DEDENT
Case: case Pattern : Block | case Pattern if Named : Block
Pattern: PatternItem%,,
PatternItem: Bor | Bor as Name | * Name
Named: Test | Name := Test
Test: Lo | Lo if Lo else Test | Lambda
Lambda: lambda : Test | lambda LParam%,, : Test
LParam: Name | Name = Test | * | * Name | ** Name | /
Lo: Nt | Lo and Nt | Lo or Nt
Nt: Cmp | not Nt
Cmp: Bor | Cmp CMP Bor | Cmp > Bor | Cmp < Bor | Cmp in Bor | Cmp not in Bor | Cmp is Bor | Cmp is not Bor
Bor: Un | Bor BIN Un | Bor SIGN Un | Bor * Un | Bor / Un | Bor @ Un
Un: Power | SIGN Un | ~ Un
Power: Prim | Prim ** Un | await Prim | await Prim ** Un
Prim: Name | NUM | Strings | ... | None | True | False | ( ) | ( Inside ) | [ ] | [ Inside ] | { } | { Entries } | { Inside } | Prim . Name | Prim ( ) | Prim ( Arg%,, ) | Prim [ Sub%,, ]
Strings: STR | Strings STR
Inside: StarTest%,, | Named CompFor | Yield
Entries: Entry%,, | Test : Test CompFor
Entry: Test : Test | ** Bor
CompFor: for Target in Lo CompIf* CompFor? | async for Target in Lo CompIf* CompFor?
CompIf: if Lo | if Name := Lo
Arg: Named | Named CompFor | Name = Test | * Test | ** Test | Bor as Name | Name = Bor as Name
Sub: Named | Slice | * Bor
Slice: Test? : Test? | Test? : Test? : Test?
Name: ID | match | case | type
"""

JS_COMMON = """
Block: { Stmt* }
Stmt: Block | Var ; | ; | Expr ; | If | For | while ( Expr ) Stmt | do Stmt while ( Expr ) ; | do Stmt while ( Expr ) | continue Label? ; | break Label? ; | return Expr? ; | throw Expr ; | Switch | Try | Func | Class | Name : Stmt | debugger ; | with ( Expr ) Stmt Extra
Label: Name
Var: var Decl%, | let Decl%, | const Decl%,
Bind: Name | Array | Object
If: if ( Expr ) Stmt | if ( Expr ) Stmt else Stmt
For: for await? ( ForVar of Assign ) Stmt | for await? ( ForVar in Expr ) Stmt | for ( Var ; Expr? ; Expr? ) Stmt | for ( Expr? ; Expr? ; Expr? ) Stmt
ForVar: var Bind | let Bind | const Bind | Post
Switch: switch ( Expr ) { Clause* }
Clause: case Expr : Stmt* | default : Stmt*
Try: try Block Catch | try Block Finally | try Block Catch Finally
Finally: finally Block
Expr: Assign | Expr , Assign
Assign: Cond | Un = Assign | Un ASG Assign | ArrowFn | yield | yield Assign | yield * Assign
Cond: Bin | Bin ? Assign : Assign
Bin: Un | Bin BinOp Un | PRIVATE in Un
BinOp: BIN | SIGN | * | < | > | in | instanceof | BAR | & | /
Un: Post | PRE Un | SIGN Un | INC Un | typeof Un | void Un | delete Un | await Un
Call: Prim | Call . PName | Call . PRIVATE | Call ?. PName | Call ?. PRIVATE | Call ?. Args | Call ?. [ Expr ] | Call [ Expr ] | Call Args | Call TPL | new NewCall | import Args
NewCall: Prim | NewCall . PName | NewCall [ Expr ] | new NewCall
Prim: this | super | Name | NUM | STR | REGEX | TPL | true | false | null | Array | Object | FuncExpr | ClassExpr | ( Expr ) | new . PName | import . PName
Args: ( ) | ( Arg%,, )
Arg: Assign | ... Assign
Body: Block | Assign
Array: [ Elems ]
Elems: Elem? | Elems , Elem?
Elem: Assign | ... Assign
Object: { } | { Prop%,, }
Prop: PKey : Assign | Name | Name = Assign | ... Assign | Method
PKey: PName | STR | NUM | [ Assign ]
"""

JAVASCRIPT = JS_COMMON + """
Program: Stmt*
Extra: EMPTY
Decl: Bind | Bind = Assign
Catch: catch Block | catch ( Bind ) Block
Post: Call | Call INC
ArrowFn: Name => Body | ( ) => Body | ( Param%,, ) => Body | async Name => Body | async ( ) => Body | async ( Param%,, ) => Body
Param: Bind | Bind = Assign | ... Bind
Params: ( ) | ( Param%,, )
Func: function Name Params Block | function * Name Params Block | async function Name Params Block | async function * Name Params Block
FuncExpr: function Name? Params Block | function * Name? Params Block | async function Name? Params Block | async function * Name? Params Block
Method: PKey Params Block | * PKey Params Block | async PKey Params Block | async * PKey Params Block | get PKey Params Block | set PKey Params Block
Class: class Name Heritage? { Member* }
ClassExpr: class Name? Heritage? { Member* }
Heritage: extends Call
Member: ; | Static? MMethod | Static? MKey ; | Static? MKey = Assign ; | static Block
MMethod: MKey Params Block | * MKey Params Block | async MKey Params Block | async * MKey Params Block | get MKey Params Block | set MKey Params Block
MKey: PKey | PRIVATE
Static: static
Name: ID | async | of | get | set | static | let | await
PName: Name | break | case | catch | class | const | continue | debugger | default | delete | do | else | export | extends | false | finally | for | function | if | import | in | instanceof | new | null | return | super | switch | this | throw | true | try | typeof | var | void | while | with | yield | enum
"""

TYPESCRIPT = JS_COMMON + """
Program: Item*
Item: Stmt | Import | Export
Import: import STR ; | import Name from STR ; | import Clauses from STR ; | import Name , Clauses from STR ; | import type Name from STR ; | import type Clauses from STR ; | import Name = Call ; | import type Name , Clauses from STR ;
Clauses: { } | { Spec%,, } | * as Name
Spec: PName | PName as PName | type PName | type PName as PName | STR as PName
Export: export Clauses ; | export Clauses from STR ; | export * from STR ; | export * as PName from STR ; | export type Clauses ; | export type Clauses from STR ; | export Var ; | export Func | export Class | export Ts | export default Func | export default Class | export default Interface | export default Assign ; | export default FuncExpr | export default ClassExpr | export = Expr ; | export as namespace Name ;
Extra: EMPTY
Stmt: Ts
Ts: Interface | type Name TParams? = Type ; | enum Name { } | enum Name { EnumItem%,, } | const enum Name { EnumItem%,, } | declare Var ; | declare Func | declare Class | declare Ts | namespace Dotted ModBody | module Dotted ModBody | declare module STR ModBody | declare global ModBody | abstract Class | Decorator+ Class | Decorator+ export Class | Decorator+ abstract Class | FuncHead ;
ModBody: { Item* }
Dotted: Name | Dotted . Name
EnumItem: PName | PName = Assign | STR = Assign | STR
Interface: interface Name TParams? Ext? { TMember* }
Ext: extends TRef%,
TMember: TSig TEnd | TSig
TEnd: ; | ,
TSig: Readonly? PKey Opt? Ann? | PKey Opt? TParams? TParamList Ann? | TParams? TParamList Ann? | new TParams? TParamList Ann? | Readonly? [ Name : Type ] Ann | get PKey TParamList Ann? | set PKey TParamList
Readonly: readonly | SIGN readonly
Opt: ?
Ann: : Type | : Guard
Guard: Name is Type | asserts Name is Type | asserts Name | this is Type
TParams: < TParam%,, >
TParam: TMod* Name | TMod* Name extends Type | TMod* Name = Type | TMod* Name extends Type = Type
TMod: const | in | out
TParamList: ( ) | ( Param%,, )
Type: Uni | Uni extends Uni ? Type : Type | TParams? TParamList => Type | TParams? TParamList => Guard | new TParams? TParamList => Type | abstract new TParamList => Type
Uni: Inter | BAR Inter | Uni BAR Inter
Inter: TPost | & TPost | Inter & TPost
TPost: TPrim | TPost [ ] | TPost [ Type ] | keyof TPost | unique TPost | readonly TPost | infer Name | infer Name extends TPrim | typeof TQuery
TQuery: Name | this | import Args | TQuery . PName | TQuery TArgs
TPrim: TRef | STR | NUM | SIGN NUM | TPL | true | false | null | void | this | ( Type ) | { TMember* } | { Mapped } | [ ] | [ TElem%,, ] | import Args
Mapped: Readonly? [ Name in Type ] MOpt? Ann? TEnd? | Readonly? [ Name in Type as Type ] MOpt? Ann? TEnd?
MOpt: ? | SIGN ?
TElem: Type | ... Type | Name : Type | Name ? : Type | ... Name : Type | Type ?
TRef: Dotted | Dotted TArgs
TArgs: < Type%, >
Decl: Bind Bang? Ann? | Bind Bang? Ann? = Assign
Bang: PRE
Catch: catch Block | catch ( Bind Ann? ) Block
Post: Call | Call INC
Call: Call PRE | Call TArgs Args | NewCall TArgs Args | Call TArgs TPL
Un: < Type > Un
BinOp: > > | > > >
NewCall: NewCall TArgs
Bin: Bin as Type | Bin as const | Bin satisfies Type
ArrowFn: Name => Body | TParams? TParamList Ann? => Body | async Name => Body | async TParams? TParamList Ann? => Body
Param: PMod* Bind Opt? Ann? | PMod* Bind Opt? Ann? = Assign | ... Bind Ann? | this Ann
PMod: public | private | protected | readonly | override | Decorator
Decorator: @ DCall
DCall: Name | DCall . PName | DCall Args | ( Expr )
Params: TParams? TParamList Ann?
FuncHead: function Name Params | async function Name Params
Func: function Name Params Block | function * Name Params Block | async function Name Params Block | async function * Name Params Block
FuncExpr: function Name? Params Block | function * Name? Params Block | async function Name? Params Block | async function * Name? Params Block
Method: PKey Params Block | * PKey Params Block | async PKey Params Block | async * PKey Params Block | get PKey Params Block | set PKey Params Block
Class: class Name TParams? Heritage* { Member* }
ClassExpr: class Name? TParams? Heritage* { Member* }
Heritage: extends Call | extends Call TArgs | implements TRef%,
Member: ; | MMod* MMethod | MMod* MKey MOpt2? Ann? ; | MMod* MKey MOpt2? Ann? = Assign ; | static Block | MMod* [ Name : Type ] Ann ;
MOpt2: ? | PRE
MMod: public | private | protected | static | readonly | abstract | override | declare | async | accessor | Decorator
MMethod: MKey Opt? Params Block | MKey Opt? Params ; | * MKey Params Block | get MKey Params Block | set MKey Params Block | get MKey Params ; | set MKey Params ;
MKey: PKey | PRIVATE
Name: ID | async | of | get | set | static | let | as | from | type | namespace | module | declare | abstract | readonly | is | asserts | infer | keyof | unique | global | public | private | protected | override | satisfies | out | accessor | implements | interface
PName: Name | break | case | catch | class | const | continue | debugger | default | delete | do | else | export | extends | false | finally | for | function | if | import | in | instanceof | new | null | return | super | switch | this | throw | true | try | typeof | var | void | while | with | yield | enum | await
"""

JAVA = """
Unit: Package? Import* TypeDecl*
Package: Annotation* package Dotted ;
Import: import Dotted ; | import static Dotted ; | import Dotted . * ; | import static Dotted . * ; | ;
TypeDecl: Mod* TypeBody | ;
TypeBody: class Name TParams? Extends? Implements? Permits? ClassBody | interface Name TParams? ExtendsMany? Permits? ClassBody | enum Name Implements? EnumBody | record Name TParams? ( ) Implements? ClassBody | record Name TParams? ( Param%, ) Implements? ClassBody | @ interface Name ClassBody
Extends: extends Type
ExtendsMany: extends Type%,
Implements: implements Type%,
Permits: permits Type%,
Mod: public | private | protected | static | final | abstract | native | synchronized | transient | volatile | strictfp | default | sealed | Annotation
Annotation: @ Dotted | @ Dotted ( ) | @ Dotted ( AnnArg%,, )
AnnArg: Name = AnnVal | AnnVal
AnnVal: Cond | Annotation | { } | { AnnVal%,, } | { , }
ClassBody: { Member* }
Member: ; | Mod* TypeBody | Mod* Type Vars ; | Mod* TParams? Type Name Params Dims? Throws? Code | Mod* TParams? void Name Params Throws? Code | Mod* TParams? Name Params Throws? Block | Mod* Name Block | Mod* Type Name ( ) default AnnVal ; | static Block | Block
Code: Block | ;
Throws: throws Type%,
Params: ( ) | ( Param%, )
Param: Mod* Type Name Dims? | Mod* Type ... Name | Mod* Type this
Dims: [ ] | Dims [ ]
EnumBody: { EnumItems? } | { EnumItems? ; Member* }
EnumItems: EnumItem%,,
EnumItem: Annotation* Name Args? ClassBody?
Type: Ref | Prim | Ref Dims | Prim Dims
Ref: AName | AName TArgs | Ref . AName | Ref . AName TArgs
AName: Annotation* Name
Prim: byte | short | int | long | char | float | double | boolean | var
TParams: < TParam%, >
TParam: Annotation* Name | Annotation* Name extends Bounds
Bounds: Type | Bounds & Type
TArgs: < > | < TArg%, >
TArg: Type | ? | ? extends Type | ? super Type | Annotation ?
Vars: VarDecl%,
VarDecl: Name Dims? | Name Dims? = Init
Init: Expr | ArrayInit
ArrayInit: { } | { Init%,, } | { , }
Block: { Stmt* }
Stmt: Block | ; | Local ; | Mod* TypeBody | ExprStmt ; | if ( Expr ) Stmt | if ( Expr ) Stmt else Stmt | while ( Expr ) Stmt | do Stmt while ( Expr ) ; | For | Switch | return Expr? ; | break Name? ; | continue Name? ; | throw Expr ; | yield Expr ; | Try | synchronized ( Expr ) Block | assert Expr ; | assert Expr : Expr ; | Name : Stmt
Local: Mod* Type Vars
ExprStmt: Un ASG Expr | Un = Expr | INC Un | Post
For: for ( ForInit? ; Expr? ; ForStep? ) Stmt | for ( Mod* Type Name : Expr ) Stmt
ForInit: Local | ExprStmt%,
ForStep: ExprStmt%,
Switch: switch ( Expr ) { Group* }
Group: Labels : Stmt* | Labels -> Expr ; | Labels -> Block | Labels -> throw Expr ;
Labels: case CaseItem%, Guard? | default
CaseItem: Cond | Pattern | default
Guard: when Expr
Pattern: Mod* Type Name | Type ( ) | Type ( Pattern%, ) | Type ( Pattern%, ) Name
Try: try Block Catch+ | try Block Catch* Finally | try ( Resources ) Block Catch* Finally? | try ( Resources ; ) Block Catch* Finally?
Catch: catch ( Mod* CatchType Name ) Block
CatchType: Type | CatchType BAR Type
Finally: finally Block
Expr: Cond | Un = Expr | Un ASG Expr | Lambda
Lambda: Name -> Body | ( ) -> Body | ( Name%, ) -> Body | ( Param%, ) -> Body
Body: Expr | Block
Cond: Bin | Bin ? Expr : Cond | Bin ? Expr : Lambda
Bin: Un | Bin BinOp Un | Bin instanceof Type | Bin instanceof Pattern | Bin instanceof final Type Name
BinOp: BIN | SIGN | * | < | > | > > | > > > | BAR | & | >=
Un: Post | SIGN Un | PRE Un | INC Un | Cast
Cast: ( Prim ) Un | ( Prim Dims ) Un | ( Ref ) CastArg | ( Ref Dims ) CastArg | ( Bounds & Type ) CastArg
CastArg: Post | PRE Un | Cast | Lambda | SwitchExpr
Post: Primary | Post INC | SwitchExpr
SwitchExpr: switch ( Expr ) { Group* }
Primary: NUM | STR | true | false | null | this | super | Name | ( Expr ) | Primary . Name | Primary . this | Primary . class | Primary . super | Primary . new Creator | Primary . TArgs Name Args | Primary Args | Primary [ Expr ] | new Creator | Primary :: Name | Primary :: new | Type :: Name | Type :: new | Ref Dims . class | Prim . class | Prim Dims . class | void . class
Creator: Ref Args ClassBody? | CRef DimExprs Dims? | CRef Dims ArrayInit
CRef: Ref | Prim
DimExprs: [ Expr ] | DimExprs [ Expr ]
Args: ( ) | ( Expr%, )
Dotted: Name | Dotted . Name
Name: ID | record | sealed | permits | yield | when | var
Resources: Res | Resources ; Res
Res: Mod* Type Name = Expr | Primary
"""

GO = """
File: package Name ; Import* Top*
Import: import ImportSpec ; | import ( ImportSpecs ) ; | import ( ImportSpecs ImportSpec ) ;
ImportSpecs: EMPTY | ImportSpecs ImportSpec ;
ImportSpec: STR | Name STR | . STR
Top: Decl ; | FuncDecl ;
Decl: const ConstSpec | const ( ConstSpecs ) | var VarSpec | var ( VarSpecs ) | type TypeSpec | type ( TypeSpecs )
ConstSpecs: EMPTY | ConstSpecs ConstSpec ; | ConstSpecs ConstSpec
VarSpecs: EMPTY | VarSpecs VarSpec ; | VarSpecs VarSpec
TypeSpecs: EMPTY | TypeSpecs TypeSpec ; | TypeSpecs TypeSpec
ConstSpec: Name%, | Name%, = Exprs | Name%, Type = Exprs
VarSpec: Name%, Type | Name%, = Exprs | Name%, Type = Exprs
TypeSpec: Name Type | Name = Type | Name [ TParam%,, ] Type
TParam: Name%, Constraint
Constraint: CTerm | Constraint BAR CTerm
CTerm: Type | ~ Type
FuncDecl: func Name FTParams? Signature Block? | func ( Recv ) Name Signature Block?
FTParams: [ TParam%,, ]
Recv: Type | Name Type | Name Type ,
Signature: Params Result?
Result: Type | Params
Params: ( ) | ( Param%,, )
Param: Type | Name Type | ... Type | Name ... Type
Type: TypeName | TypeName [ Type%, ] | * Type | [ ] Type | [ Expr ] Type | [ ... ] Type | map [ Type ] Type | chan Type | <- chan Type | chan <- Type | func Signature | struct { Fields } | interface { Methods } | ( Type )
TypeName: Name | Name . Name
Fields: EMPTY | Fields Field ; | Fields Field
Field: Name%, Type | Name%, Type STR | TypeName | * TypeName | TypeName STR | * TypeName STR | TypeName [ Type%, ]
Methods: EMPTY | Methods Method ; | Methods Method
Method: Name Signature | Constraint
Block: { Stmts }
Stmts: Stmt? | Stmts ; Stmt?
Stmt: Decl | Simple | Name : Stmt? | go Expr | defer Expr | return | return Exprs | break Name? | continue Name? | goto Name | fallthrough | Block | If | Switch | Select | For
Simple: Expr | Exprs = Exprs | Exprs := Exprs | Expr ASG Expr | Expr INC | Expr <- Expr
If: if Head Block | if Head Block else If | if Head Block else Block
Head: Expr | Simple ; Expr | ; Expr
Switch: switch { Clause* } | switch Simple { Clause* } | switch Simple? ; Simple? { Clause* }
Clause: case CaseList : Stmts | default : Stmts
CaseList: CaseItem%,
CaseItem: Expr | Type
Select: select { Comm* }
Comm: case Simple : Stmts | default : Stmts
For: for Block | for Expr Block | for Simple? ; Expr? ; Simple? Block | for Exprs = range Expr Block | for Exprs := range Expr Block | for range Expr Block
Exprs: Expr%,
Expr: Un | Expr BinOp Un
BinOp: BIN | SIGN | * | & | BAR | <-
Un: Prim | SIGN Un | PRE Un | * Un | & Un | <- Un | ~ Un
Prim: Name | NUM | STR | ( Expr ) | ( Type ) | Prim . Name | Prim . ( Type ) | Prim . ( type ) | Prim [ Index ] | Prim ( ) | Prim ( Arg%,, ) | Prim ( Arg%, ... ) | Prim ( Arg%, ... , ) | func Signature Block | LitType Lit | Prim Lit | [ ] Type ( Expr ) | map [ Type ] Type ( ) 
LitType: [ ] Type | [ Expr ] Type | [ ... ] Type | map [ Type ] Type | struct { Fields }
Index: Expr | Type%, | Expr? : Expr? | Expr? : Expr : Expr
Arg: Expr | Type
Lit: { } | { Elem%,, }
Elem: Value | Value : Value
Value: Expr | Lit
Name: ID
"""

C = """
File: Ext*
Ext: Function | Declaration | ; | STR ; | asm Paren ;
Function: Specs Declarator Block | Specs Declarator Declaration+ Block | Declarator Block
Declaration: Specs ; | Specs InitDecl%, ; | static_assert Paren ; | Attr Declaration
Specs: Spec+ | Spec* ID Spec* | Spec* ID Spec* ID Spec*
Spec: typedef | extern | static | auto | register | inline | const | volatile | restrict | void | char | short | int | long | float | double | signed | unsigned | bool | complex | noreturn | StructSpec | EnumSpec | typeof Paren | Attr | alignas Paren | thread
Attr: attribute Paren
Paren: ( Any* )
Any: ID | NUM | STR | , | . | Paren | const | int | char | long | unsigned | void | = | BIN | SIGN | * | : | struct
StructSpec: StructKind Attr* ID | StructKind Attr* ID? { Member* }
StructKind: struct | union
Member: Specs ; | Specs MDecl%, ; | static_assert Paren ; | ;
MDecl: Declarator Attr* | Declarator : Cond | : Cond
EnumSpec: enum ID | enum ID? { } | enum ID? { EnumItem%,, }
EnumItem: ID | ID = Cond
InitDecl: Declarator AsmAttr* | Declarator AsmAttr* = Init
AsmAttr: Attr | asm Paren
Init: Assign | { } | { InitItem%,, }
InitItem: Init | Designators = Init | ID : Init
Designators: Designator | Designators Designator
Designator: [ Cond ] | . ID | [ Cond ... Cond ]
Declarator: Direct | Pointer Direct
Pointer: * Qual* | * Qual* Pointer
Qual: const | volatile | restrict | Attr
Direct: ID | ( Declarator ) | Direct [ ] | Direct [ Cond ] | Direct [ static Cond ] | Direct [ * ] | Direct ( ) | Direct ( ParamList ) | Direct ( ID%, ) | ( Attr Declarator )
ParamList: Param%, | Param%, , ...
Param: Specs Declarator Attr* | Specs AbstractD?
AbstractD: Pointer | DirectA | Pointer DirectA
DirectA: ( AbstractD ) | [ ] | [ Cond ] | ( ) | ( ParamList ) | DirectA [ ] | DirectA [ Cond ] | DirectA ( ) | DirectA ( ParamList )
TypeName: Specs AbstractD?
Block: { BlockItem* }
BlockItem: Declaration | Stmt | Function
Stmt: Block | ; | Expr ; | ID : Stmt | ID : Declaration | case Cond : Stmt | case Cond ... Cond : Stmt | default : Stmt | case Cond : Declaration | default : Declaration | if ( Expr ) Stmt | if ( Expr ) Stmt else Stmt | switch ( Expr ) Stmt | while ( Expr ) Stmt | do Stmt while ( Expr ) ; | For | goto ID ; | continue ; | break ; | return Expr? ; | asm Qual* Paren ;
For: for ( Expr? ; Expr? ; Expr? ) Stmt | for ( Declaration Expr? ; Expr? ) Stmt
Expr: Assign | Expr , Assign
Assign: Cond | Un = Assign | Un ASG Assign
Cond: Bin | Bin ? Expr : Cond | Bin ? : Cond
Bin: Cast | Bin BinOp Cast
BinOp: BIN | SIGN | * | & | &&
Cast: Un | ( TypeName ) Cast | ( TypeName ) { } | ( TypeName ) { InitItem%,, }
Un: Post | INC Un | SIGN Cast | * Cast | PRE Cast | & Cast | && ID | sizeof Un | sizeof ( TypeName ) | alignof ( TypeName )
Post: Prim | Post [ Expr ] | Post ( ) | Post ( CArg%, ) | Post . ID | Post -> ID | Post INC
CArg: Assign | TypeName
Prim: ID | NUM | Strings | ( Expr ) | ( Block ) | generic Paren
Strings: STR | Strings STR | Strings ID | ID STR
"""

YAML = """
Stream: Doc* | Node Doc*
Doc: --- N | --- N Node | --- Flow N | --- Text N
Node: Map | Seq | Text N | Flow N | BLOCK N
Map: Pair+
Pair: KEY Val | ? Val | ? Val KEY Val
Val: N | Text N | Flow N | BLOCK N | N INDENT Node DEDENT | N Seq | Prop N | Prop N INDENT Node DEDENT
Seq: Item+
Item: - Entry
Entry: N | Text N | Flow N | BLOCK N | INDENT Node DEDENT | N INDENT Node DEDENT | Prop N INDENT Node DEDENT
Prop: TAG
Text: STR | Prop STR | ALIAS
Flow: { } | { FPair%,, } | [ ] | [ FItem%,, ] | Prop Flow2
Flow2: { FPair%,, } | [ FItem%,, ]
FPair: FKey | FKey : | FKey : FVal
FKey: STR | ALIAS | Flow
FItem: FVal | FKey : FVal | FKey :
FVal: STR | ALIAS | Flow | Prop STR
"""

TOML = """
File: Line*
Line: N | Table N | Key = Value N
Table: [ Key ] | [[ Key ]]
Key: Part | Key . Part
Part: KEY | STR
Value: STR | MSTR | NUM | Array | Inline
Array: [ Gap* ] | [ Gap* Items Gap* ] | [ Gap* Items Gap* , Gap* ]
Items: Value | Items Gap* , Gap* Value
Gap: N
Inline: { } | { IPair%, }
IPair: Key = Value
"""

#: Operators that share a class.
CLASSES = {
    "python": {"AUG": "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=", "CMP": "== != <= >=", "BIN": "% // & | ^ << >>", "SIGN": "+ -"},
    "javascript": {"ASG": "+= -= *= /= %= **= <<= >>= >>>= &= ^= |= &&= ||= ??=", "BIN": "== != === !== <= >= && || ?? ** % ^ << >> >>>", "SIGN": "+ -", "INC": "++ --", "PRE": "! ~"},
    "typescript": {"ASG": "+= -= *= /= %= **= <<= >>= >>>= &= ^= |= &&= ||= ??=", "BIN": "== != === !== <= >= && || ?? ** % ^ <<", "SIGN": "+ -", "INC": "++ --", "PRE": "! ~"},
    "java": {"ASG": "+= -= *= /= %= <<= >>= >>>= &= ^= |=", "BIN": "== != <= && || / % ^ <<", "SIGN": "+ -", "INC": "++ --", "PRE": "! ~"},
    "go": {"ASG": "+= -= *= /= %= <<= >>= &= ^= |= &^=", "BIN": "== != < <= > >= && || / % << >> &^", "SIGN": "+ - ^", "INC": "++ --", "PRE": "!"},
    "c": {"ASG": "+= -= *= /= %= <<= >>= &= ^= |=", "BIN": "== != < > <= >= || / % ^ << >> |", "SIGN": "+ -", "INC": "++ --", "PRE": "! ~"},
    "json": {}, "yaml": {}, "toml": {},
}
