"""Fixed values of the content classifier, the chunkers and the chunk checks."""

from __future__ import annotations

# Content types, patterns per type (flags inline), thresholds, label table. Results depend on each of them.
CONTENT_TYPES = ["software", "python", "math", "discrete_math", "ml", "algorithms", "data", "architecture", "foundation"]
PATTERNS = {
    "software": [
        r"\bdef\s+\w+\s*\(",
        r"\b(function|return)\s*\w*\s*[({]",
        r"(?m)^\s*(import|from)\s+\w+",
        r"(?m)[;]{1}\s*$",
        r"\b(void|public|private|static)\s+\w+\(",
    ],
    "python": [r"\bdef\s+\w+\(", r"(?m)^\s*(import|from)\s+\w+", r"\bself\.\w+", r"\bprint\("],
    "math": [
        r"\$\$?[^$\n]{2,}\$\$?",
        r"\\(begin\{|frac\{|sum_|int_|partial |nabla)",
        r"(?i)\b(theorem|lemma|corollary)\b",
        r"(?is)\bproof\b.{0,20}\bQ\.?E\.?D\.?",
        r"[∑∫∂∇≤≥≠±√]",
    ],
    "discrete_math": [
        r"(?i)\bvertex\b|\bvertices\b|\badjacency\b",
        r"(?i)\bgraph\s+(traversal|theory|coloring)\b",
        r"(?i)\bpermutations?\s+and\s+combinations?\b",
        r"(?i)\brecurrence\s+relation\b",
        r"(?i)\bbinary\s+tree\b|\bB-tree\b",
    ],
    "ml": [
        r"(?i)\b(neural network|gradient descent|loss function|training set|epoch)\b",
        r"(?i)\b(sklearn|tensorflow|pytorch)\b",
        r"(?i)\bnumpy\.|pandas\.|torch\.|nn\.",
        r"(?i)\b(classif(y|ier|ication)|regression model|overfit(ting)?)\b",
    ],
    "algorithms": [
        r"(?i)\btime complexity\b|\bspace complexity\b",
        r"\bO\(\s*(n|log|1|n\^?\d|n log n)\s*\)",
        r"(?i)\b(sorting algorithm|search algorithm|recursive algorithm)\b",
        r"(?i)\b(binary search|quicksort|mergesort|dijkstra)\b",
    ],
    "data": [
        r"(?is)\bSELECT\b.{0,100}\bFROM\b",
        r"(?i)\bJOIN\b|\bINSERT INTO\b|\bCREATE TABLE\b",
        r"(?i)\bprimary key\b|\bforeign key\b|\bdatabase schema\b",
    ],
    "architecture": [
        r"(?i)\bmicroservices?\b|\bmonolith(ic)?\b",
        r"(?i)\bsoftware architecture\b|\bdesign pattern\b",
        r"(?i)\bdependency injection\b|\bevent-driven architecture\b",
    ],
}
#: Of each pattern above, in the same order: letters or signs, in lower case, one of which stands in every match. A text without them is not searched.
GUARDS = {
    "software": [["def"], ["function", "return"], ["import", "from"], [";"], ["void", "public", "private", "static"]],
    "python": [["def"], ["import", "from"], ["self."], ["print("]],
    "math": [["$"], ["\\begin{", "\\frac{", "\\sum_", "\\int_", "\\partial ", "\\nabla"], ["theorem", "lemma", "corollary"], ["proof"], list("∑∫∂∇≤≥≠±√")],
    "discrete_math": [["vertex", "vertices", "adjacency"], ["graph"], ["permutation"], ["recurrence"], ["binary", "b-tree"]],
    "ml": [["neural", "gradient", "loss", "training", "epoch"], ["sklearn", "tensorflow", "pytorch"], ["numpy.", "pandas.", "torch.", "nn."], ["classif", "regression", "overfit"]],
    "algorithms": [["complexity"], ["o("], ["algorithm"], ["binary", "quicksort", "mergesort", "dijkstra"]],
    "data": [["select"], ["join", "insert", "create"], ["key", "schema"]],
    "architecture": [["microservice", "monolith"], ["architecture", "pattern"], ["injection", "architecture"]],
}
#: Letters that match i, k or s if case is ignored, but are other letters in lower case.
CASE_FOLDS = "[\u0130\u0131\u017f\u212a]"
LABEL_DENSITY = 2.5
CODE_DENSITY, MATH_DENSITY, FENCES = 0.3, 1.0, 1
FENCE = r"(?s)```(.*?)```"
FENCE_TOKEN = r"\b(?:def|class|return|import|function|void|public|private)\b|\w+\s*\([^)]*\)\s*[:{]|;\s*$"
CODE_FENCE = r"```[\w]*\n([\s\S]*?)```"
INDENTED = r"(?m)^(?: {4}|\t)(.+)"
FORMULA = r"\$\$[\s\S]+?\$\$|\$[^\$\n]+?\$|\\begin\{[^}]+\}[\s\S]+?\\end\{[^}]+\}"
PLACEHOLDER = r"\[CODE_\d+\]"
CODE_SIGNS = ["def ", "class ", "import ", "    return ", "=>", "};"]
SENTENCE_ENDS = ".!?\"'`)]}"
LABELS = [
    ("The Data Science Design Manual", ["foundation"]),
    ("Data Science From Scratch", ["foundation"]),
    ("Python Programming With Design Patterns", ["python", "software"]),
    ("Effective Python", ["python", "software"]),
    ("Clean Code", ["foundation", "software"]),
    ("Code Complete", ["foundation", "software"]),
    ("Fundamentals of Software Architecture", ["architecture"]),
    ("Software Architecture The Hard Parts", ["architecture"]),
    ("A Mathematical Introduction to Data Science", ["math"]),
    ("Stats and Calculus Workshop with Python", ["math", "python"]),
    ("Mathematics of Machine Learning", ["math", "ml"]),
    ("An Introduction to Statistical Learning with Applications in Python", ["math", "ml"]),
    ("The Elements of Statistical Learning", ["math", "ml"]),
    ("An Introduction to the Analysis of Algorithms", ["algorithms"]),
    ("Mathematical Structures for Computer Science", ["algorithms", "data", "discrete_math"]),
    ("Learning SQL", ["data"]),
    ("SQL for Data Scientists", ["data"]),
    ("Python Machine Learning", ["ml", "python"]),
    ("Machine Learning Algorithms", ["algorithms", "ml"]),
]
PATH_RULES = [("software", "software"), ("dev", "software"), ("code", "software"), ("math", "math"), ("maths", "math"), ("self", "selfhelp"), ("help", "selfhelp"), ("personal", "selfhelp")]
MODES = ["mix", "hybrid", "local", "global", "naive"]
ENTITY_TYPES = ["Concept", "Technology", "Person", "Method", "Term"]
RELATION_TYPES = ["RELATES_TO", "IS_A", "USES", "DEFINED_AS", "PART_OF"]
