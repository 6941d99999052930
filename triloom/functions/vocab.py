"""Fixed vocabularies of the data model."""

from __future__ import annotations

#: The ten edge types of the type-count vector, in order.
EDGE_TYPES = ["FLOWS_TO", "DECLARES", "IS_CLASS_OF", "REACHES", "CONTROLS", "DOM", "POST_DOM", "USE", "DEF", "IS_AST_PARENT"]

#: The 69 node types of the type-count vector, in order.
NODE_TYPES = [
    "CallExpression", "Callee", "Function", "ArgumentList", "AssignmentExpr", "File", "IdentifierDeclStatement", "Parameter",
    "Symbol", "PostIncDecOperationExpression", "Identifier", "IncDec", "ExpressionStatement", "AssignmentExpression",
    "ArrayIndexing", "IfStatement", "Condition", "AdditiveExpression", "Argument", "PrimaryExpression", "CastExpression",
    "CastTarget", "PtrMemberAccess", "Statement", "ReturnStatement", "EqualityExpression", "ElseStatement", "ParameterType",
    "ParameterList", "SizeofExpression", "IdentifierDeclType", "UnaryOperator", "MultiplicativeExpression", "MemberAccess",
    "FunctionDef", "AndExpression", "CFGEntryNode", "UnaryOperationExpression", "ForStatement", "ForInit", "ShiftExpression",
    "ReturnType", "Sizeof", "BreakStatement", "OrExpression", "WhileStatement", "SizeofOperand", "IdentifierDecl",
    "CompoundStatement", "CFGExitNode", "RelationalExpression", "BitAndExpression", "CFGErrorNode", "ClassDef",
    "ClassDefStatement", "ConditionalExpression", "ContinueStatement", "Decl", "DeclStmt", "DoStatement",
    "ExclusiveOrExpression", "Expression", "GotoStatement", "InclusiveOrExpression", "InitializerList", "Label",
    "SwitchStatement", "UnaryExpression", "InfiniteForNode",
]

#: Positions 0 to 9 count edges, 10 to 78 nodes.
VECTOR_DIMS = EDGE_TYPES + NODE_TYPES

#: Edges that touch these node types give no triple.
BOUNDARY_TYPES = ["CFGEntryNode", "CFGExitNode", "ENTRY", "EXIT"]
