"""Properties of syntax nodes: the type that a path shows, and the name that a leaf shows, as columns over a table of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.text import normalize_name, split_to_subtokens

# Types whose operator is part of the type; boxed types and what they box; numerals that keep their text.
WITH_OPERATOR = ("BinaryExpr", "UnaryExpr", "AssignExpr")
UNBOXED = {"Boolean": "boolean", "Byte": "byte", "Character": "char", "Double": "double", "Float": "float", "Integer": "int", "Long": "long", "Short": "short"}
NUMERALS_KEPT = ("0", "1", "32", "64")
MAX_NAME = 50
METHOD_NAME, NUMERAL, GENERIC, PRIMITIVE, CLASS_TYPE = "METHOD_NAME", "<NUM>", "GenericClass", "PrimitiveType", "ClassOrInterfaceType"
# Short names of types in paths.
SHORT_NAMES = {
    "ArrayAccessExpr": "ArAc", "ArrayBracketPair": "ArBr", "ArrayCreationExpr": "ArCr", "ArrayCreationLevel": "ArCrLvl", "ArrayInitializerExpr": "ArIn", "ArrayType": "ArTy",
    "AssertStmt": "Asrt", "AssignExpr:and": "AsAn", "AssignExpr:assign": "As", "AssignExpr:lShift": "AsLS", "AssignExpr:minus": "AsMi", "AssignExpr:or": "AsOr", "AssignExpr:plus": "AsP",
    "AssignExpr:rem": "AsRe", "AssignExpr:rSignedShift": "AsRSS", "AssignExpr:rUnsignedShift": "AsRUS", "AssignExpr:slash": "AsSl", "AssignExpr:star": "AsSt", "AssignExpr:xor": "AsX",
    "BinaryExpr:and": "And", "BinaryExpr:binAnd": "BinAnd", "BinaryExpr:binOr": "BinOr", "BinaryExpr:divide": "Div", "BinaryExpr:equals": "Eq", "BinaryExpr:greater": "Gt",
    "BinaryExpr:greaterEquals": "Geq", "BinaryExpr:less": "Ls", "BinaryExpr:lessEquals": "Leq", "BinaryExpr:lShift": "LS", "BinaryExpr:minus": "Minus", "BinaryExpr:notEquals": "Neq",
    "BinaryExpr:or": "Or", "BinaryExpr:plus": "Plus", "BinaryExpr:remainder": "Mod", "BinaryExpr:rSignedShift": "RSS", "BinaryExpr:rUnsignedShift": "RUS", "BinaryExpr:times": "Mul",
    "BinaryExpr:xor": "Xor", "BlockStmt": "Bk", "BooleanLiteralExpr": "BoolEx", "CastExpr": "Cast", "CatchClause": "Catch", "CharLiteralExpr": "CharEx", "ClassExpr": "ClsEx",
    "ClassOrInterfaceDeclaration": "ClsD", "ClassOrInterfaceType": "Cls", "ConditionalExpr": "Cond", "ConstructorDeclaration": "Ctor", "DoStmt": "Do", "DoubleLiteralExpr": "Dbl",
    "EmptyMemberDeclaration": "Emp", "EnclosedExpr": "Enc", "ExplicitConstructorInvocationStmt": "ExpCtor", "ExpressionStmt": "Ex", "FieldAccessExpr": "Fld", "FieldDeclaration": "FldDec",
    "ForeachStmt": "Foreach", "ForStmt": "For", "IfStmt": "If", "InitializerDeclaration": "Init", "InstanceOfExpr": "InstanceOf", "IntegerLiteralExpr": "IntEx",
    "IntegerLiteralMinValueExpr": "IntMinEx", "LabeledStmt": "Labeled", "LambdaExpr": "Lambda", "LongLiteralExpr": "LongEx", "MarkerAnnotationExpr": "MarkerExpr", "MemberValuePair": "Mvp",
    "MethodCallExpr": "Cal", "MethodDeclaration": "Mth", "MethodReferenceExpr": "MethRef", "NameExpr": "Nm", "NormalAnnotationExpr": "NormEx", "NullLiteralExpr": "Null",
    "ObjectCreationExpr": "ObjEx", "Parameter": "Prm", "PrimitiveType": "Prim", "QualifiedNameExpr": "Qua", "ReturnStmt": "Ret", "SingleMemberAnnotationExpr": "SMEx",
    "StringLiteralExpr": "StrEx", "SuperExpr": "SupEx", "SwitchEntryStmt": "SwiEnt", "SwitchStmt": "Switch", "SynchronizedStmt": "Sync", "ThisExpr": "This", "ThrowStmt": "Thro",
    "TryStmt": "Try", "TypeDeclarationStmt": "TypeDec", "TypeExpr": "Type", "TypeParameter": "TypePar", "UnaryExpr:inverse": "Inverse", "UnaryExpr:negative": "Neg", "UnaryExpr:not": "Not",
    "UnaryExpr:posDecrement": "PosDec", "UnaryExpr:posIncrement": "PosInc", "UnaryExpr:positive": "Pos", "UnaryExpr:preDecrement": "PreDec", "UnaryExpr:preIncrement": "PreInc",
    "UnionType": "Unio", "VariableDeclarationExpr": "VDE", "VariableDeclarator": "VD", "VariableDeclaratorId": "VDID", "VoidType": "Void", "WhileStmt": "While", "WildcardType": "Wild",
}


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def is_boxed(node_type: Column, text: Column) -> Column:
    return (node_type == CLASS_TYPE) & text.isin(*UNBOXED)


def path_type(node_type: Column, operator: Column, text: Column, generic_leaf: Column) -> Column:
    """The type with its operator; boxed types are primitive ones; a generic type that counts as a leaf has a type of its own."""
    plain = F.when(is_boxed(node_type, text), F.lit(PRIMITIVE)).otherwise(node_type)
    with_operator = F.when(node_type.isin(*WITH_OPERATOR) & (F.coalesce(operator, F.lit("")) != ""), F.concat(plain, F.lit(":"), operator)).otherwise(plain)
    return F.when(generic_leaf, F.lit(GENERIC)).otherwise(with_operator)


def short_type(path_type: Column) -> Column:
    return F.coalesce(F.try_element_at(_table(SHORT_NAMES), path_type), path_type)


def leaf_name(node_type: Column, path_type: Column, text: Column, own_name: Column, generic: Column, parent_type: Column) -> Column:
    """Parts of the text (of a generic type: of its own name), joined by pipes. A text without parts shows its letters, at most 50, or what its type
    boxes; numerals without parts are one token but for a few; the name of a method declaration is masked."""
    parts = F.array_join(split_to_subtokens(F.when(generic, own_name).otherwise(text)), "|")
    letters = normalize_name(text, "BLANK")
    boxed = F.try_element_at(_table(UNBOXED), text)
    name = F.when(F.length(letters) > MAX_NAME, F.substring(letters, 1, MAX_NAME)).when(is_boxed(node_type, text), boxed).otherwise(letters)
    numeral = F.when((node_type == "IntegerLiteralExpr") & ~name.isin(*NUMERALS_KEPT), F.lit(NUMERAL)).otherwise(name)
    method = F.coalesce((path_type == "NameExpr") & (parent_type == "MethodDeclaration"), F.lit(False))
    return F.when(method, F.lit(METHOD_NAME)).when(parts != "", parts).otherwise(numeral)


def with_properties(nodes: DataFrame) -> DataFrame:
    """nodes (node_type, operator, text, own_name, generic, is_leaf, parent_type) with path_type, short_type and name. Null texts are empty,
    null operators and parents none."""
    text = F.coalesce("text", F.lit(""))
    kind = F.col("node_type")
    generic = F.coalesce("generic", F.lit(False)) & (kind == CLASS_TYPE)
    out = nodes.withColumn("path_type", path_type(kind, F.col("operator"), text, generic & F.coalesce("is_leaf", F.lit(False))))
    return out.withColumns({"short_type": short_type(F.col("path_type")), "name": leaf_name(kind, F.col("path_type"), text, F.coalesce("own_name", F.lit("")), generic, F.col("parent_type"))})


def is_leaf(kind: Column, n_children: Column, text: Column, comment: str = "Comment", statement: str = "Stmt") -> Column:
    """A node without children that is neither a comment nor a statement, and whose text isn't empty, nor `null` but for the literal."""
    return (n_children == 0) & ~kind.endswith(comment) & ~kind.endswith(statement) & (F.coalesce(text, F.lit("")) != "") & ((text != "null") | (kind == "NullLiteralExpr"))


# Kinds of tokens that are leaves, and names that stand for code that was wrapped.
IDENTIFIER_KINDS = ("IdentifierToken",)
LITERAL_KINDS = ("NumericLiteralToken", "StringLiteralToken", "CharacterLiteralToken")


def is_leaf_token(kind: Column, text: Column, parents: Column, dummies: tuple[str, ...] = ()) -> Column:
    """Leaf tokens of the C# flavour. parents: kinds of the nodes above, the nearest first. `var` as the type of a local declaration is none."""
    inferred = (text == "var") & (kind == "IdentifierToken") & (F.slice(parents, 1, 3) == F.array(*map(F.lit, ("IdentifierName", "VariableDeclaration", "LocalDeclarationStatement"))))
    dummy = text.isin(*dummies) if dummies else F.lit(False)
    return ~F.coalesce(inferred, F.lit(False)) & ~dummy & F.coalesce(kind.isin(*IDENTIFIER_KINDS, *LITERAL_KINDS) | (F.try_element_at(parents, F.lit(1)) == "PredefinedType"), F.lit(False))
