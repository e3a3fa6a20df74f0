"""Grammars of the supported languages and their dialects, for single functions and methods as well as whole files.

They decide whether tokens form a sentence, so operators have no precedence, and names and types aren't resolved. A
dialect is the text of an older one and the rules that it changes; DIALECTS has them by language.
"""

from __future__ import annotations

PYTHON = r"""
unit = stmt+ EOF ;
stmt = simple (';' simple)* ';'? NEWLINE | compound ;
suite = simple (';' simple)* ';'? NEWLINE | NEWLINE INDENT stmt+ DEDENT ;
name = ID | 'match' | 'case' | 'type' | '_' ;
simple = exprs | assign | augmented | annotated | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (test ('from' test)?)?
  | 'del' targets | 'assert' test (',' test)? | ('global' | 'nonlocal') name (',' name)*
  | 'import' dotted ('as' name)? (',' dotted ('as' name)?)*
  | 'from' ('.' | '...')* dotted 'import' imported | 'from' ('.' | '...')+ 'import' imported
  | 'type' name typeparams? '=' test ;
imported = '*' | '(' name ('as' name)? (',' name ('as' name)?)* ','? ')' | name ('as' name)? (',' name ('as' name)?)* ;
dotted = name ('.' name)* ;
assign = (targets '=')+ (exprs | yieldexpr) ;
augmented = single AUG (exprs | yieldexpr) ;
annotated = single ':' test ('=' (exprs | yieldexpr))? ;
single = name | atom trailer* ('.' name | '[' subscripts ']') | '(' single ')' ;
target = name | atom trailer* ('.' name | '[' subscripts ']') | '(' targets? ')' | '[' targets? ']' | '*' target ;
targets = target (',' target)* ','? ;
exprs = star (',' star)* ','? | yieldexpr ;
star = test | '*' or ;
yieldexpr = 'yield' (exprs | 'from' test)? ;
test = or ('if' or 'else' test)? | 'lambda' lparams? ':' test ;
named = test | name ':=' test ;
or = operand (binop operand)* ;
binop = 'or' | 'and' | 'in' | 'not' 'in' | 'is' | BINOP | '|' | SIGN | SLASH | '*' | '**' | '@' ;
operand = ('not' | SIGN | '~' | 'await')* atom trailer* ;
atom = name | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' (inner | yieldexpr)? ')' | '[' inner? ']' | '{' (dict | inner)? '}' ;
inner = item (',' item)* ','? | item compfor ;
item = named | '*' or ;
dict = pair (',' pair)* ','? | pair compfor ;
pair = test ':' test | '**' or ;
trailer = '.' name | '(' args? ')' | '[' subscripts ']' ;
args = arg (',' arg)* ','? ;
arg = named compfor? | name '=' test | '*' test | '**' test ;
subscripts = subscript (',' subscript)* ','? ;
subscript = named | '*' or | test? ':' test? (':' test?)? ;
compfor = 'async'? 'for' targets 'in' or ('async'? 'for' targets 'in' or | 'if' (or | name ':=' test | 'lambda' lparams? ':' test))* ;
lparams = lparam (',' lparam)* ','? ;
lparam = name ('=' test)? | '*' name? | '**' name | SLASH ;
params = param (',' param)* ','? ;
param = name (':' test)? ('=' test)? | '*' (name (':' star)?)? | '**' name (':' test)? | SLASH ;
typeparams = '[' ('*' | '**')? name (':' test)? ('=' test)? (',' ('*' | '**')? name (':' test)? ('=' test)?)* ','? ']' ;
compound = decorated | 'async' (funcdef | forstmt | withstmt) | funcdef | classdef | forstmt | withstmt
  | 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)?
  | 'while' named ':' suite ('else' ':' suite)?
  | 'try' ':' suite (('except' '*'? (test (',' test)* ('as' name)?)? ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)? | 'finally' ':' suite)
  | 'match' exprs ':' NEWLINE INDENT ('case' pattern ('if' named)? ':' suite)+ DEDENT ;
pattern = asp (',' asp)* ','? ;
asp = orp ('as' name)? | '*' name ;
orp = closedp ('|' closedp)* ;
closedp = SIGN? NUM (SIGN NUM)? | STR+ | 'None' | 'True' | 'False' | dotted ('(' (parg (',' parg)* ','?)? ')')? | '(' pattern? ')' | '[' pattern? ']' | '{' (ppair (',' ppair)* ','?)? '}' ;
parg = asp | name '=' asp ;
ppair = closedp ':' asp | '**' name ;
decorated = ('@' named NEWLINE)+ ('async'? funcdef | classdef) ;
funcdef = 'def' name typeparams? '(' params? ')' ('->' test)? ':' suite ;
classdef = 'class' name typeparams? ('(' args? ')')? ':' suite ;
forstmt = 'for' targets 'in' exprs ':' suite ('else' ':' suite)? ;
withstmt = 'with' (withitem (',' withitem)* | '(' withitem (',' withitem)* ','? ')') ':' suite ;
withitem = test ('as' target)? ;
"""

# NL: a line break that can end a statement; TPL...: template pieces
JAVASCRIPT = r"""
unit = script EOF | NL? method+ NL? EOF ;
script = stmt+ ;
id = ID | 'let' | 'of' | 'get' | 'set' | 'async' | 'static' | 'from' | 'as' | 'await' | 'yield' ;
anyname = id | KEYWORD | 'function' | 'return' | 'if' | 'else' | 'for' | 'while' | 'do' | 'switch' | 'case' | 'default' | 'break' | 'continue' | 'throw' | 'try' | 'catch' | 'finally'
  | 'var' | 'const' | 'new' | 'in' | 'instanceof' | 'class' | 'extends' | 'import' | 'export' | 'this' | 'super' | 'debugger' | UNARYWORD | LITERALWORD | 'with' ;
end = ';' | NL ;
block = '{' stmt* '}' ;
stmt = end | block | decl end | expr end | 'if' '(' expr ')' NL? stmt (NL? 'else' NL? stmt)? | 'while' '(' expr ')' NL? stmt
  | 'do' NL? stmt NL? 'while' '(' expr ')' end?
  | 'for' 'await'? '(' forhead ')' NL? stmt
  | ('break' | 'continue') id? end | 'return' expr? end | 'throw' expr end | 'debugger' end
  | 'switch' '(' expr ')' NL? '{' NL? (('case' expr | 'default') ':' stmt*)* '}'
  | 'try' NL? block NL? (catch (NL? 'finally' NL? block)? | 'finally' NL? block)
  | id ':' NL? stmt | function | class
  | 'import' importclause? STR end | 'export' ('default'? (function | class) | decl end | 'default' assign end | '{' NL? (anyname ('as' anyname)? (',' anyname ('as' anyname)?)* ','?)? NL? '}' ('from' STR)? end | '*' ('as' anyname)? 'from' STR end) ;
importclause = (id (',' id)? | '*' 'as' id | (id ',')? '{' NL? (anyname ('as' id)? (',' anyname ('as' id)?)* ','?)? NL? '}') 'from' ;
catch = 'catch' ('(' binding ')')? NL? block ;
decl = ('var' | 'let' | 'const') binding ('=' assign)? (',' binding ('=' assign)?)* ;
forhead = (decl | expr)? ';' expr? ';' expr? | (('var' | 'let' | 'const') binding | postfixed) ('of' | 'in') expr ;
binding = id | '[' (','* element)? (','+ element)* ','* ']' | '{' NL? (prop (',' prop)* ','?)? NL? '}' ;
element = binding ('=' assign)? | '...' binding ;
prop = key ':' binding ('=' assign)? | id ('=' assign)? | '...' binding ;
key = anyname | STR | NUM | '[' assign ']' | PRIVATE ;
function = 'async'? 'function' '*'? id? '(' params? ')' NL? block ;
params = element (',' element)* ','? ;
class = 'class' id? ('extends' postfixed)? '{' (end | member)* '}' ;
member = 'static'? method | 'static'? key ('=' assign)? end | 'static' block ;
method = 'static'? ('async' '*'? | '*' | 'get' | 'set')? key '(' params? ')' NL? block ;
expr = assign (',' assign)* ;
assign = operand (binop operand | '?' assign ':' assign)* | arrow | 'yield' '*'? assign | operand (binop operand)* binop (arrow | 'yield' '*'? assign) ;
arrow = 'async'? (id | '(' params? ')') '=>' (block | assign) ;
binop = BINOP | ASSIGN | '=' | '*' | '+' | '-' | SLASH | 'in' | 'instanceof' ;
operand = (UNARY | UNARYWORD | '+' | '-' | INC | 'await')* postfixed INC? ;
postfixed = 'new'* primary trailer* | 'new' '.' anyname ;
trailer = '.' (anyname | PRIVATE) | '?.' (anyname | PRIVATE | '[' expr ']' | '(' args? ')') | '[' expr ']' | '(' args? ')' | template ;
args = arg (',' arg)* ','? ;
arg = '...'? assign ;
primary = id | NUM | STR | REGEX | 'this' | 'super' | LITERALWORD | template | '(' expr ')' | '[' (','* arg)? (','+ arg)* ','* ']'
  | '{' NL? (member2 (',' member2)* ','?)? NL? '}' | function | class | 'import' ('(' args ')' | '.' anyname) | PRIVATE ;
member2 = key ':' assign | id ('=' assign)? | '...' assign | method ;
template = TPL | TPLHEAD expr (TPLMID expr)* TPLTAIL ;
"""

JAVA = r"""
unit = member+ EOF | block EOF | ('package' qname ';')? ('import' 'static'? qname ('.' '*')? ';')* typedecl+ EOF ;
id = ID | 'record' | 'var' | 'yield' | 'sealed' | 'permits' | 'when' ;
qname = id ('.' id)* ;
mods = (MOD | 'sealed' | 'static' | 'default' | 'final' | 'synchronized' | annotation)+ ;
annotation = '@' qname ('(' (annarg (',' annarg)*)? ')')? ;
annarg = id '=' annval | annval ;
annval = annotation | expr | '{' (annval (',' annval)* ','?)? '}' ;
type = annotation* (PRIM | qname typeargs? ('.' id typeargs?)*) (annotation* '[' ']')* ;
typeargs = '<' (typearg (',' typearg)*)? '>' ;
typearg = type | '?' (('extends' | 'super') type)? ;
typeparams = '<' id ('extends' type ('&' type)*)? (',' id ('extends' type ('&' type)*)?)* '>' ;
member = mods? typeparams? (type | 'void')? id '(' params? ')' ('[' ']')* ('throws' type (',' type)*)? (block | ';' | 'default' annval ';')
  | mods? type declarator (',' declarator)* ';' | mods? typedecl2 | 'static'? block | ';' | mods? id block ;
typedecl = mods? typedecl2 | ';' ;
typedecl2 = 'class' id typeparams? ('extends' type)? ('implements' type (',' type)*)? ('permits' type (',' type)*)? body
  | 'interface' id typeparams? ('extends' type (',' type)*)? ('permits' type (',' type)*)? body | '@' 'interface' id body
  | 'enum' id ('implements' type (',' type)*)? '{' (const (',' const)* ','?)? (';' member*)? '}'
  | 'record' id typeparams? '(' params? ')' ('implements' type (',' type)*)? body ;
const = annotation* id ('(' args? ')')? body? ;
body = '{' member* '}' ;
params = param (',' param)* ;
param = ('final' | annotation)* type ('...')? (id | 'this') ('[' ']')* ;
declarator = id ('[' ']')* ('=' init)? ;
init = expr | arrayinit ;
arrayinit = '{' (init (',' init)* ','?)? '}' ;
block = '{' stmt* '}' ;
stmt = block | ';' | local ';' | exprstmt ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' (local | exprs)? ';' expr? ';' exprs? ')' stmt | 'for' '(' ('final' | annotation)* type id ':' expr ')' stmt
  | ('break' | 'continue') id? ';' | 'return' expr? ';' | 'throw' expr ';' | 'yield' expr ';'
  | 'try' ('(' resource (';' resource)* ';'? ')')? block (catch)* ('finally' block)? | switch
  | 'synchronized' '(' expr ')' block | id ':' stmt | 'assert' expr (':' expr)? ';' | (MOD | 'sealed' | 'static' | 'final' | annotation)* typedecl2 ;
resource = ('final' | annotation)* type id '=' expr | expr ;
catch = 'catch' '(' ('final' | annotation)* type ('|' type)* id ')' block ;
local = ('final' | annotation)* type declarator (',' declarator)* ;
exprs = expr (',' expr)* ;
exprstmt = INC postfixed | primary trailer* (INC | ASSIGN expr | '=' expr)? | cast2 ;
cast2 = postfixed (ASSIGN | '=') expr ;
switch = 'switch' '(' expr ')' '{' (label ':' stmt* | label '->' (exprstmt ';' | expr ';' | block | 'throw' expr ';'))* '}' ;
label = 'case' caseval (',' caseval)* ('when' expr)? | 'default' ;
caseval = expr | type id | 'default' ;
expr = operand (binop operand | 'instanceof' ('final'? type id? ) | '?' expr ':' (expr | lambda))* | lambda | operand (binop operand)* (ASSIGN | '=') lambda ;
lambda = (id | '(' (id (',' id)*)? ')' | '(' params ')') '->' (expr | block) ;
binop = BINOP | ASSIGN | '=' | '<' | '>' | '>' '>' | '>' '>' '>' | '&' | '|' | '*' | SIGN ;
operand = (SIGN | NOT | INC | '(' type ('&' type)* ')')* postfixed INC? ;
postfixed = primary trailer* ;
trailer = '.' typeargs? (id | 'this' | 'super' | 'class' | 'new' creator) | '[' expr ']' | '(' args? ')' | '::' (id | 'new') ;
args = (expr | lambda) (',' (expr | lambda))* ;
primary = id | NUM | STR | CHAR | LIT | 'this' | 'super' | '(' (expr | lambda) ')' | 'new' creator | PRIM ('[' ']')* ('.' 'class' | '::' 'new') | 'void' '.' 'class' | qname ('[' ']')+ ('.' 'class' | '::' 'new') | qname typeargs '::' (id | 'new') | switch ;
creator = annotation* (PRIM | qname typeargs? ('.' id typeargs?)*) ('(' args? ')' body? | ('[' expr ']')+ ('[' ']')* | ('[' ']')+ arrayinit) ;
"""

GO = r"""
unit = ('package' ID ';')? ('import' (importspec | '(' (importspec (';' importspec)* ';'?)? ')') ';')* (top ';'?)+ EOF ;
importspec = ('.' | ID)? STR ;
top = func | decl ;
func = 'func' ('(' params? ')')? ID typeparams? sig block? ;
typeparams = '[' ID (',' ID)* constraint (',' ID (',' ID)* constraint)* ','? ']' ;
constraint = '~'? type ('|' '~'? type)* ;
sig = '(' params? ')' result? ;
result = type | '(' params? ')' ;
params = param (',' param)* ','? ;
param = (ID)? '...'? type ;
type = ID ('.' ID)? ('[' type (',' type)* ']')? | '*' type | '[' ('...' | expr)? ']' type | 'map' '[' type ']' type | 'chan' CHANOP? type | CHANOP 'chan' type | 'func' sig | '(' type ')'
  | 'struct' '{' (field (';' field)* ';'?)? '}' | 'interface' '{' (elem (';' elem)* ';'?)? '}' ;
field = (ID (',' ID)* type | '*'? ID ('.' ID)?) STR? ;
elem = ID sig | constraint ;
decl = 'var' (spec | '(' (spec (';' spec)* ';'?)? ')') | 'const' (cspec | '(' (cspec (';' cspec)* ';'?)? ')') | 'type' (tspec | '(' (tspec (';' tspec)* ';'?)? ')') ;
spec = ID (',' ID)* (type ('=' exprs)? | '=' exprs) ;
cspec = ID (',' ID)* (type? '=' exprs)? ;
tspec = ID typeparams? '='? type ;
block = '{' stmts? '}' ;
stmts = ';'* stmt (';'+ stmt)* ';'* | ';'+ ;
stmt = simple | decl | block | 'return' exprs? | 'go' expr | 'defer' expr | ('break' | 'continue' | 'goto') ID? | 'fallthrough' | ID ':' stmt? | ifstmt
  | 'for' forhead? block | 'switch' (simple? ';')? simple? '{' ((('case' (exprs | types)) | 'default') ':' stmts?)* '}' | 'select' '{' (('case' simple | 'default') ':' stmts?)* '}' ;
types = type (',' type)* ;
ifstmt = 'if' (simple? ';')? expr block ('else' (ifstmt | block))? ;
forhead = expr | simple? ';' expr? ';' simple? | (exprs ('=' | ':='))? 'range' expr ;
simple = exprs | exprs (ASSIGN | '=' | ':=') exprs | expr INC | expr CHANOP expr ;
exprs = expr (',' expr)* ;
expr = operand (binop operand)* ;
binop = BINOP | '*' | SIGN | '|' ;
operand = (SIGN | NOT | '*' | CHANOP | '~')* primary trailer* ;
primary = ID | NUM | STR | CHAR | '(' expr ')' | 'func' sig block | littype literal | convtype '(' expr ','? ')' | '(' '*' type ')' ;
littype = ID ('.' ID)? ('[' type (',' type)* ']')? | '[' ('...' | expr)? ']' type | 'map' '[' type ']' type | 'struct' '{' (field (';' field)* ';'?)? '}' ;
convtype = '[' expr? ']' type | 'map' '[' type ']' type | 'chan' type | CHANOP 'chan' type | 'interface' '{' '}' | 'func' sig ;
literal = '{' (element (',' element)* ','?)? '}' ;
element = (value ':')? value ;
value = expr | literal ;
trailer = '.' ID | '.' '(' (type | 'type') ')' | '[' (expr | type (',' type)+ | expr? ':' expr? (':' expr)?) ']' | '(' (arg (',' arg)* '...'? ','?)? ')' ;
arg = expr | type ;
"""

PHP = r"""
unit = OPEN? stmt+ CLOSE? EOF | OPEN? member+ EOF ;
name = ID | NSNAME ;
anyid = ID | KEYWORD | MOD | CASTID | 'function' | 'fn' | 'static' | 'abstract' | 'final' | 'class' | 'new' | 'use' | 'as' | 'if' | 'else' | 'elseif' | 'while' | 'do' | 'for' | 'foreach' | 'switch' | 'case' | 'default' | 'match' | 'return' | 'echo' | 'print' | 'global' | 'try' | 'catch' | 'finally' | 'throw' | 'const' | 'interface' | 'trait' | 'enum' | 'extends' | 'implements' | 'instanceof' | 'namespace' | 'break' | 'continue' | 'isset' | 'empty' | 'unset' | 'list' | 'array' | 'clone' | 'yield' | 'from' | 'include' | 'goto' | 'exit' | 'declare' | 'readonly' | WORDOP | 'endif' | 'endwhile' | 'endfor' | 'endforeach' | 'endswitch' ;
block = '{' stmt* '}' ;
stmt = block | ';' | expr ';' | 'if' '(' expr ')' (stmt ('elseif' '(' expr ')' stmt | 'else' 'if' '(' expr ')' stmt)* ('else' stmt)? | ':' stmt* ('elseif' '(' expr ')' ':' stmt*)* ('else' ':' stmt*)? 'endif' ';')
  | 'while' '(' expr ')' (stmt | ':' stmt* 'endwhile' ';') | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' exprs? ';' exprs? ';' exprs? ')' (stmt | ':' stmt* 'endfor' ';')
  | 'foreach' '(' expr 'as' (expr '=>')? '&'? expr ')' (stmt | ':' stmt* 'endforeach' ';')
  | 'switch' '(' expr ')' ('{' cases '}' | '{' '}' | ':' cases 'endswitch' ';')
  | ('break' | 'continue') expr? ';' | 'return' expr? ';' | 'echo' exprs ';' | 'global' VAR (',' VAR)* ';' | 'static' VAR ('=' expr)? (',' VAR ('=' expr)?)* ';'
  | 'unset' '(' exprs ','? ')' ';' | 'try' block (catch+ ('finally' block)? | 'finally' block) | function | class | 'const' anyid '=' expr (',' anyid '=' expr)* ';'
  | 'namespace' name (';' | block) | 'use' ('function' | 'const')? name ('as' ID)? (',' name ('as' ID)?)* ';' | ID ':' | 'goto' ID ';' | 'declare' '(' ID '=' expr ')' (stmt | ';') | CLOSE OPEN ;
cases = (('case' expr | 'default') (':' | ';') stmt*)+ ;
catch = 'catch' '(' name ('|' name)* VAR? ')' block ;
function = attr* 'function' '&'? anyid '(' params? ')' (':' type)? block ;
attr = ATTR args2? (',' expr)* ']' ;
args2 = expr ;
params = param (',' param)* ','? ;
param = attr* (MOD | 'readonly')* type? '&'? '...'? VAR ('=' expr)? ;
type = '?'? (name | CASTID | 'array' | 'static' | LIT | '(' type ')') (('|' | '&') (name | CASTID | 'array' | 'static' | LIT | '(' type ')'))* ;
class = attr* ('abstract' | 'final' | 'readonly')* 'class' ID ('extends' name)? ('implements' name (',' name)*)? body | 'interface' ID ('extends' name (',' name)*)? body | 'trait' ID body | 'enum' ID (':' type)? ('implements' name (',' name)*)? body ;
body = '{' member* '}' ;
member = attr* mods? 'function' '&'? anyid '(' params? ')' (':' type)? (block | ';') | mods type? VAR ('=' expr)? (',' VAR ('=' expr)?)* ';' | mods? 'const' type? anyid '=' expr (',' anyid '=' expr)* ';' | 'use' name (',' name)* (';' | block) | 'case' ID ('=' expr)? ';' ;
mods = (MOD | 'static' | 'abstract' | 'final' | 'readonly')+ ;
exprs = expr (',' expr)* ;
expr = operand (binop operand | 'instanceof' operand | '?' expr? ':' operand)* ;
binop = BINOP | ASSIGN | '=' | '=' '&' | '&' | '|' | SIGN | WORDOP ;
operand = (SIGN | UNARY | INC | CAST | '&' | 'clone' | 'print' | 'include' | 'throw')* (primary trailer* INC? | 'new' newexpr trailer* | closure | 'yield' (expr ('=>' expr)? | 'from' expr)? | matchexpr) ;
newexpr = (name | 'static' | VAR trailer2* | '(' expr ')') ('(' args? ')')? | 'class' ('(' args? ')')? ('extends' name)? ('implements' name (',' name)*)? body ;
trailer2 = '->' ID | '::' VAR | '[' expr ']' ;
closure = 'static'? attr* 'function' '&'? '(' params? ')' ('use' '(' ('&'? VAR (',' '&'? VAR)* ','?)? ')')? (':' type)? block | 'static'? attr* 'fn' '&'? '(' params? ')' (':' type)? '=>' expr ;
matchexpr = 'match' '(' expr ')' '{' (marm (',' marm)* ','?)? '}' ;
marm = ('default' | exprs ','?) '=>' expr ;
primary = VAR | DOLLAR+ (VAR | '{' expr '}') | name | NUM | STR | LIT | HEREDOC | '(' expr ')' | '[' items? ']' | ('array' | 'list') '(' items? ')' | 'isset' '(' exprs ','? ')' | 'empty' '(' expr ')' | 'exit' ('(' expr? ')')? | 'static' '::' (anyid | VAR) | CASTID ;
items = (item? ',')* item ','? | ','+ ;
item = (expr '=>')? '&'? expr | '...' expr ;
trailer = '->' (anyid | VAR | '{' expr '}') | '::' (anyid | VAR) | '[' expr? ']' | '(' args? ')' | '{' expr '}' ;
args = arg (',' arg)* ','? | '...' ;
arg = '...'? expr | anyid ':' expr ;
"""

_C_COMMON = r"""
block = '{' stmt* '}' ;
cond = expr | decl1 ;
stmt = block | ';' | decl | exprs ';' | 'if' IFMOD? '(' (decl | exprs ';')? cond (',' expr)* ')' stmt ('else' stmt)? | 'while' '(' cond (',' expr)* ')' stmt | 'do' stmt 'while' '(' exprs ')' ';'
  | 'for' '(' (decl | exprs? ';') exprs? ';' exprs? ')' stmt | RANGEFOR '(' decl0 ':' expr ')' stmt | 'switch' '(' cond ')' stmt | 'case' expr ('...' expr)? ':' stmt? | 'default' ':' stmt? | ID ':' stmt?
  | 'break' ';' | 'continue' ';' | 'return' (exprs | braces)? ';' | 'goto' (ID | '*' expr) ';' | 'asm' QUAL* ('(' asmbody ')') ';' | other ;
asmbody = (expr | ':' | ',' | '[' ID ']')+ ;
exprs = expr (',' expr)* ;
braces = '{' (init (',' init)* ','?)? '}' ;
init = (designator+ '=' | ID ':')? (expr | braces) ;
designator = '[' expr ('...' expr)? ']' | '.' ID ;
enum = 'enum' ENUMCLASS? attr* ID? (':' spec)? ('{' ID ('=' expr)? (',' ID ('=' expr)?)* ','? '}')? ;
attr = ATTR '(' anything* ')' ;
anything = '(' anything* ')' | ID | NUM | STR+ | ',' | KEYWORDS | '=' | '.' | '::' ;
"""

C = r"""
unit = external+ EOF ;
external = function | decl | ';' | 'asm' '(' STR+ ')' ';' ;
function = attr* spec declarator1 attr* block ;
qual = QUAL | 'static' | attr ;
spec = qual* (BASE (BASE | qual)* | (struct | enum | TYPEOF '(' (expr | typename) ')') qual* | ID qual*) ;
struct = STRUCT attr* (ID ('{' field* '}')? | '{' field* '}') attr* ;
field = spec (fdeclarator (',' fdeclarator)*)? attr* ';' | ';' ;
fdeclarator = declarator (':' expr)? | ':' expr ;
pointer = ('*' qual*)+ ;
declarator = pointer? (ID | '(' attr* declarator ')') suffix* ;
declarator1 = pointer? (ID | '(' declarator1 ')') '(' (dparams | 'void')? ')' suffix* ;
suffix = '[' ('static' | QUAL)* (expr | '*')? ']' | '(' (params | ID (',' ID)*)? ')' ;
abstract = pointer (('(' abstract ')')? suffix+ | '(' abstract ')')? | ('(' abstract ')')? suffix+ | '(' abstract ')' ;
params = param (',' param)* (',' '...')? ;
param = spec (declarator | abstract)? attr* ;
dparams = dparam (',' dparam)* (',' '...')? ;
dparam = spec declarator attr* | BASE ;
typename = spec abstract? ;
decl = spec (idecl (',' idecl)*)? ';' | 'static_assert' '(' expr (',' STR+)? ')' ';' ;
decl0 = spec declarator ;
decl1 = NEVER ;
other = NEVER ;
idecl = declarator ('asm' '(' STR+ ')')? attr* ('=' (expr | braces))? ;
expr = operand (binop operand | '?' exprs? ':' operand)* ;
binop = BINOP | ASSIGN | '=' | '<' | '>' | '*' | '&' | '&&' | SIGN ;
operand = (SIGN | NOT | INC | '*' | '&' | '&&' | 'sizeof' | '(' typename ')')* primary trailer* | (SIGN | NOT | '*' | '(' typename ')')* ('sizeof' | ALIGNOF) '(' typename ')' ;
primary = ID | NUM | STR+ | CHAR | '(' exprs ')' | '(' block ')' | '(' typename ')' braces | GENERIC '(' expr (',' (typename | 'default') ':' expr)+ ')' | OFFSETOF '(' typename ',' expr ')' ;
trailer = '.' ID | '->' ID | '[' exprs ']' | '(' (arg (',' arg)*)? ')' | INC ;
arg = expr | typename2 ;
typename2 = QUAL* BASE (BASE | QUAL)* abstract? | struct abstract? ;
""" + _C_COMMON

CPP = r"""
unit = external+ EOF ;
external = function | decl | ';' | template | namespace | using | special | 'extern' STR ('{' external* '}' | function | decl) | 'asm' '(' STR+ ')' ';' ;
namespace = 'inline'? 'namespace' (ID ('::' ID)*)? '{' external* '}' | 'namespace' ID '=' qname ';' ;
using = 'using' ('namespace' qname | 'typename'? qname | ID attr2* '=' typename) ';' | 'using' 'enum' qname ';' ;
template = 'template' ('<' (tparam (',' tparam)*)? '>')? ('requires' operand)? (function | decl | template | special | using | friend) ;
friend = 'friend' (function | decl | 'class' qname ';') ;
tparam = (('class' | 'typename' | 'template' '<' (tparam (',' tparam)*)? '>' ('class' | 'typename')) '...'? ID? ('=' typename)?) | param ;
attr2 = '[' '[' anything* ']' ']' | attr | 'alignas' '(' (expr | typename) ')' ;
qual = QUAL | attr2 | 'explicit' | 'virtual' | 'friend' | 'inline' | 'extern' ;
qname = '::'? seg ('::' 'template'? (seg | '~' ID | opname))* ;
seg = ID targs? ;
targs = '<' (targ (',' targ)*)? '>' ;
targ = (typename | texpr) '...'? ;
texpr = operand (tbinop operand)* ;
tbinop = BINOP | '*' | '&' | SIGN | '<' ;
opname = 'operator' (OPNAME | BINOP | ASSIGN | '=' | '<' | '>' | '*' | '&' | '&&' | SIGN | NOT | INC | '->' | ',' | '(' ')' | '[' ']' | STR ID | ('new' | 'delete') ('[' ']')? | typename0) ;
typename0 = QUAL* (BASE+ | '::'? seg ('::' seg)*) ('*' | '&' | '&&')* ;
spec = qual* (BASE (BASE | qual)* | (class | enum | 'decltype' '(' exprs ')' | 'typename'? '::'? seg ('::' 'template'? seg)* | 'auto') qual*) ;
barespec = qual* (BASE (BASE | qual)* | ('decltype' '(' exprs ')' | 'auto' | 'typename'? '::'? ID targs ('::' 'template'? seg)* | '::' seg ('::' seg)* | ID ('::' 'template'? seg)+) qual* | STRUCT ID) ;
class = (STRUCT | 'class') attr2* ('::'? seg ('::' seg)* 'final'? bases? ('{' cmember* '}')? | bases? '{' cmember* '}') ;
bases = ':' ('virtual' | ACCESS)* qname '...'? (',' ('virtual' | ACCESS)* qname '...'?)* ;
cmember = ACCESS ':' | function | special | spec (fdeclarator (',' fdeclarator)*)? ';' | template | using | friend | ';' | decl ;
fdeclarator = declarator ('=' (expr | NUM) | braces)? | declarator? ':' expr ;
pointer = (('*' | '&' | '&&') QUAL*)+ | qname '::' '*' QUAL* ;
dname = qname | opname | '(' attr2* declarator ')' | '[' ID (',' ID)* ']' | '...' ID ;
declarator = pointer* dname suffix* ;
suffix = '[' exprs? ']' | '(' (params)? ')' after* ('->' typename)? ;
after = QUAL | 'noexcept' ('(' expr ')')? | '&' | '&&' | 'override' | 'final' | 'throw' '(' (typename (',' typename)*)? ')' | attr2 | 'requires' operand ;
function = attr2* spec pointer* (qname | opname) '(' dparams? ')' after* ('->' typename)? (tryblock | block | '=' ('default' | 'delete') ';') ;
special = qual* (qname | qname '::' '~' ID | '~' ID | opname | qname '::' opname) '(' dparams? ')' after* (inits? block | ';' | '=' ('default' | 'delete' | NUM) ';' | 'try' inits? block catch+) ;
tryblock = 'try' inits? block catch+ ;
inits = ':' minit (',' minit)* ;
minit = qname ('(' args? ')' | braces) '...'? ;
dparams = dparam (',' dparam)* (','? '...')? | '...' ;
dparam = spec pointer* dname suffix* ('=' (expr | braces))? | barespec abstract? ('=' (expr | braces))? | spec abstract2 ;
abstract2 = pointer+ ;
params = param (',' param)* (','? '...')? | '...' ;
param = spec (declarator | abstract)? ('=' (expr | braces))? ;
abstract = pointer+ absuffix* | absuffix+ ;
absuffix = '(' (pointer* qname? absuffix* | params) ')' after* | '[' expr? ']' | '...' ;
typename = spec abstract? ;
decl = spec (idecl (',' idecl)*)? ';' | 'static_assert' '(' expr (',' STR+)? ')' ';' | using ;
decl0 = spec declarator ;
decl1 = spec pointer* dname ('=' expr | braces) ;
idecl = declarator ('=' (expr | braces) | braces | '(' args ')')? ;
other = 'try' block catch+ | 'throw' exprs? ';' | 'co_return' exprs? ';' ;
catch = 'catch' '(' ('...' | param) ')' block ;
expr = operand (binop operand | '?' exprs ':' operand)* | operand (binop operand)* (ASSIGN | '=') braces | 'throw' expr ;
binop = BINOP | ASSIGN | '=' | '<' | '>' | '>' '>' | '*' | '&' | '&&' | SIGN | WORDOP | MEMBERPTR ;
operand = (SIGN | NOT | INC | '*' | '&' | '~' | 'sizeof' | CO | '(' typename ')')* primary trailer* | (SIGN | NOT | '*' | '(' typename ')')* ('sizeof' | ALIGNOF) '...'? '(' typename ')' ;
primary = qname | opname | NUM | STR+ ID? | CHAR | LIT | '(' exprs ')' | '(' typename ')' braces | braces1 | CASTOP '<' typename '>' '(' exprs ')' | 'typeid' '(' (exprs | typename) ')' | lambda | '::'? 'new' ('(' args ')')? newtype ('(' args? ')' | braces)? | '::'? 'delete' ('[' ']')? operand | (BASE+ | 'typename' '::'? seg ('::' seg)*) ('(' args? ')' | braces) | 'noexcept' '(' expr ')' ;
braces1 = qname braces ;
newtype = spec pointer? ('[' expr ']')* | '(' typename ')' ;
lambda = '[' (capture (',' capture)*)? ']' ('<' tparam (',' tparam)* '>')? ('(' params? ')' (LAMBDAMOD | after)* ('->' typename)?)? block ;
capture = '=' | '&' | '&'? ID ('...' | '=' expr | braces)? | '*'? 'this' ;
trailer = ('.' | '->') 'template'? (qname | '~' ID | opname) | '[' (exprs | braces) ']' | '(' args? ')' | INC ;
args = (expr | braces) '...'? (',' (expr | braces) '...'?)* ;
""" + _C_COMMON


C_KR = C + r"""
function = attr* spec declarator1 attr* block | attr* spec declaratorkr decl+ block ;
declaratorkr = pointer? (ID | '(' declaratorkr ')') '(' ID (',' ID)* ')' ;
"""

C_23 = C + r"""
attr = ATTR '(' anything* ')' | '[' '[' anything* ']' ']' ;
anything = '(' anything* ')' | ID | NUM | STR+ | ',' | KEYWORDS | '=' | '.' | '::' | ':' | QUAL | SIGN ;
decl = spec (idecl (',' idecl)*)? ';' | qual+ ID '=' (expr | braces) (',' ID '=' (expr | braces))* ';' | 'static_assert' '(' expr (',' STR+)? ')' ';' | attr ';' ;
stmt = attr* (block | ';' | decl | exprs ';' | 'if' '(' (decl | exprs ';')? cond ')' stmt ('else' stmt)? | 'while' '(' cond ')' stmt | 'do' stmt 'while' '(' exprs ')' ';'
  | 'for' '(' (decl | exprs? ';') exprs? ';' exprs? ')' stmt | 'switch' '(' cond ')' stmt | 'case' expr ('...' expr)? ':' stmt? | 'default' ':' stmt? | ID ':' stmt?
  | 'break' ';' | 'continue' ';' | 'return' exprs? ';' | 'goto' (ID | '*' expr) ';' | 'asm' QUAL* ('(' asmbody ')') ';') ;
"""

CPP_20 = CPP + r"""
external = function | decl | ';' | template | concept | namespace | using | special | 'extern' STR ('{' external* '}' | function | decl) | 'asm' '(' STR+ ')' ';' ;
concept = 'template' '<' (tparam (',' tparam)*)? '>' ID ID '=' constraint ';' ;
constraint = expr ;
requiresexpr = 'requires' ('(' params ')')? '{' requirement* '}' ;
requirement = expr ';' | 'typename' qname ';' | '{' expr '}' 'noexcept'? ('->' typename)? ';' | 'requires' expr ';' ;
template = 'template' ('<' (tparam (',' tparam)*)? '>')? ('requires' constraint)? (function | decl | template | special | using | friend) ;
tparam = (('class' | 'typename' | 'template' '<' (tparam (',' tparam)*)? '>' ('class' | 'typename') | qname) '...'? ID? ('=' typename)?) | param ;
param = 'this'? spec 'auto'? (declarator | abstract)? ('=' (expr | braces))? | LIT spec (declarator | abstract)? ;
dparam = spec 'auto'? pointer* dname suffix* ('=' (expr | braces))? | LIT spec pointer* dname | barespec 'auto'? abstract? ('=' (expr | braces))? | spec abstract2 ;
qual = QUAL | attr2 | 'explicit' ('(' expr ')')? | 'virtual' | 'friend' | 'inline' | 'extern' ;
stmt = attr2* (block | ';' | decl | exprs ';' | 'if' (IFMOD '!'? block | IFMOD? '(' (decl | exprs ';')? cond (',' expr)* ')' attr2* stmt) ('else' attr2* stmt)? | 'while' '(' cond (',' expr)* ')' attr2* stmt | 'do' stmt 'while' '(' exprs ')' ';'
  | 'for' '(' (decl | exprs? ';') exprs? ';' exprs? ')' stmt | RANGEFOR '(' (decl | exprs? ';')? decl0 ':' (expr | braces) ')' stmt | 'for' '(' (decl | exprs? ';') decl0 ':' (expr | braces) ')' stmt | 'switch' '(' (decl | exprs ';')? cond ')' stmt | 'case' expr ('...' expr)? ':' stmt? | 'default' ':' stmt? | ID ':' stmt?
  | 'break' ';' | 'continue' ';' | 'return' (exprs | braces)? ';' | 'goto' (ID | '*' expr) ';' | 'asm' QUAL* ('(' asmbody ')') ';' | other) ;
primary = qname | opname | NUM | STR+ ID? | CHAR | LIT | '(' exprs ')' | '(' fold ')' | requiresexpr | '(' typename ')' braces | braces1 | CASTOP '<' typename '>' '(' exprs ')' | 'typeid' '(' (exprs | typename) ')' | lambda | '::'? 'new' ('(' args ')')? newtype ('(' args? ')' | braces)? | '::'? 'delete' ('[' ']')? operand | (BASE+ | 'auto' | 'typename' '::'? seg ('::' seg)*) ('(' args? ')' | braces) | 'noexcept' '(' expr ')' ;
fold = operand binop '...' (binop operand)? | '...' binop operand ;
trailer = ('.' | '->') 'template'? (qname | '~' ID | opname) | '[' (exprs | braces)? ']' | '(' args? ')' | INC ;
"""

JAVA_21 = JAVA + r"""
pattern = ('final' | annotation)* type id | type '(' (pattern (',' pattern)*)? ')' id? ;
expr = operand (binop operand | 'instanceof' ('final' | annotation)* (type id? | pattern) | '?' expr ':' (expr | lambda))* | lambda | operand (binop operand)* (ASSIGN | '=') lambda ;
label = 'case' caseval (',' caseval)* ('when' expr)? | 'default' ;
caseval = expr | pattern | 'default' ;
"""

PYTHON_36 = PYTHON + r"""
name = ID | 'match' | 'case' | 'type' | '_' | 'async' | 'await' ;
"""

JAVASCRIPT_NEXT = JAVASCRIPT + r"""
decorator = DECORATOR ;
class = 'class' id? ('extends' postfixed)? '{' (end | member)* '}' ;
primary = id | NUM | STR | REGEX | 'this' | 'super' | LITERALWORD | template | '(' expr ')' | '[' (','* arg)? (','+ arg)* ','* ']'
  | '{' NL? (member2 (',' member2)* ','?)? NL? '}' | function | class | 'import' ('(' args ')' | '.' anyname) | PRIVATE ;
stmt = end | block | decl end | expr end | 'if' '(' expr ')' NL? stmt (NL? 'else' NL? stmt)? | 'while' '(' expr ')' NL? stmt
  | 'do' NL? stmt NL? 'while' '(' expr ')' end?
  | 'for' 'await'? '(' forhead ')' NL? stmt
  | ('break' | 'continue') id? end | 'return' expr? end | 'throw' expr end | 'debugger' end
  | 'switch' '(' expr ')' NL? '{' NL? (('case' expr | 'default') ':' stmt*)* '}'
  | 'try' NL? block NL? (catch (NL? 'finally' NL? block)? | 'finally' NL? block)
  | id ':' NL? stmt | function | class
  | 'import' importclause? STR attributes? end | 'export' ('default'? (function | class) | decl end | 'default' assign end | '{' NL? (anyname ('as' anyname)? (',' anyname ('as' anyname)?)* ','?)? NL? '}' ('from' STR attributes?)? end | '*' ('as' anyname)? 'from' STR attributes? end) ;
attributes = 'with' '{' NL? ((anyname | STR) ':' STR (',' (anyname | STR) ':' STR)* ','?)? NL? '}' ;
"""
JAVASCRIPT_NEXT = JAVASCRIPT_NEXT.replace("decorator = DECORATOR ;\n", "")

PHP_84 = PHP + r"""
member = attr* mods? 'function' '&'? anyid '(' params? ')' (':' type)? (block | ';') | attr* mods type? VAR ('=' expr)? (',' VAR ('=' expr)?)* ';' | attr* mods type? VAR ('=' expr)? hooks | attr* mods? 'const' type? anyid '=' expr (',' anyid '=' expr)* ';' | 'use' name (',' name)* (';' | block) | attr* 'case' ID ('=' expr)? ';' ;
hooks = '{' hook+ '}' ;
hook = attr* 'final'? '&'? ID ('(' params ')')? (block | '=>' expr ';' | ';') ;
mods = (MOD ('(' ID ')')? | 'static' | 'abstract' | 'final' | 'readonly')+ ;
"""

#: Dialects of each language, run together.
DIALECTS = {
    "c": {"K&R": C_KR, "C11": C, "C23": C_23},
    "cpp": {"C++17": CPP, "C++20": CPP_20},
    "java": {"8 to 17": JAVA, "21": JAVA_21},
    "python": {"3.6": PYTHON_36, "3.13": PYTHON},
    "javascript": {"2022": JAVASCRIPT, "2025": JAVASCRIPT_NEXT},
    "go": {"1.22": GO},
    "php": {"8.3": PHP, "8.4": PHP_84},
}
