"""Word lists and patterns that decide how questions are answered. All are matched as substrings of the lower-cased question."""

from __future__ import annotations

# Marks of sensitive questions, in the order in which hits are reported.
SENSITIVE = (
    "salary", "compensation", "payroll", "ssn", "social security", "password", "passwd", "credential", "api key",
    "secret key", "private key", "confidential", "proprietary", "nda", "internal only", "internal-only",
    "personal data", "pii", "patient", "diagnosis", "medical record", "bank account", "termination", "layoff", "lawsuit",
    "เงินเดือน", "ค่าจ้าง", "รหัสผ่าน", "บัตรประชาชน", "เลขบัตรประชาชน", "ความลับ", "ข้อมูลส่วนบุคคล", "ข้อมูลส่วนตัว",
    "บัญชีธนาคาร", "เลขบัญชี", "เลิกจ้าง",
)

# Marks of questions that need reasoning.
REASONING = (
    "why", "how does", "how do", "compare", "contrast", "explain", "difference between", "trade-off", "tradeoff",
    "trade off", "pros and cons", "analyze", "evaluate", "assess", "implication", "synthesize", "derive", "prove",
    "rationale", "root cause", "step by step", "reason about", "relationship between", "depend on", "depends on",
    "design", "architect",
    "ทำไม", "เพราะอะไร", "เปรียบเทียบ", "อธิบาย", "วิเคราะห์", "ประเมิน", "ข้อดีข้อเสีย", "ข้อดีและข้อเสีย", "แตกต่าง",
    "ความสัมพันธ์", "ผลกระทบ", "สาเหตุ", "ขึ้นอยู่กับ", "ออกแบบ",
)

# Marks of plain look-ups.
SIMPLE = (
    "what is", "what's", "who is", "who's", "when is", "when did", "where is", "define", "definition of", "list the",
    "how many", "how much",
    "คืออะไร", "ใคร", "ที่ไหน", "เมื่อไร", "เมื่อไหร่", "กี่", "เท่าไร", "เท่าไหร่", "ความหมายของ",
)

# Marks of questions that ask for an aggregate.
ANALYTICAL = (
    "total", "sum of", "how many", "count of", "number of", "average", "avg", "mean", "median", "maximum", "minimum",
    "highest", "lowest", "most", "least", "per month", "per year", "per day", "by month", "by year", "by region",
    "grouped by", "trend", "growth", "percentage of",
    "ยอดรวม", "ยอดขาย", "รวมทั้งหมด", "ทั้งหมดกี่", "จำนวน", "กี่", "เฉลี่ย", "ค่าเฉลี่ย", "มากที่สุด", "น้อยที่สุด", "สูงสุด",
    "ต่ำสุด", "ต่อเดือน", "ต่อปี", "ต่อวัน", "แต่ละเดือน", "แต่ละปี", "เปอร์เซ็นต์", "ร้อยละ", "แนวโน้ม",
)

# Marks of questions about the whole corpus.
OVERVIEW = (
    "overall", "in general", "main theme", "main topics", "key themes", "key topics", "across all", "whole corpus",
    "high-level", "high level", "summarize the", "summary of all", "recurring", "what themes", "what are the themes",
    "common themes", "big picture",
    "ภาพรวม", "ธีมหลัก", "หัวข้อหลัก", "โดยรวม", "สรุปทั้งหมด",
)

# Patterns of attempts to override instructions; ignoring case, the first match is reported.
INJECTION = (
    r"ignore\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|above|earlier|preceding)\s+(?:instruction|prompt|context|rule)",
    r"disregard\s+(?:all\s+|any\s+|the\s+)?(?:previous|prior|above|system)\s+(?:instruction|prompt|rule)",
    r"forget\s+(?:all|everything|your)\s+(?:previous\s+|prior\s+)?(?:instruction|rule)",
    r"(?:reveal|show|print|repeat|leak)\s+(?:me\s+)?(?:your\s+|the\s+)?(?:system\s+)?(?:prompt|instruction)",
    r"you\s+are\s+now\s+(?:a|an|in)\b",
    r"act\s+as\s+(?:if\s+you\s+are\s+|an?\s+)?(?:dan|jailbreak|developer\s+mode)",
    r"developer\s+mode",
    r"\bjailbreak\b",
    r"override\s+(?:your\s+|the\s+)?(?:safety\s+|system\s+)?(?:instruction|rule|setting)",
    r"ข้าม(?:คำสั่ง|กฎ)",
    r"เพิกเฉย(?:ต่อ)?คำสั่ง",
)

# Words that a read-only statement may not have, and suffixes of documents that are read.
FORBIDDEN_SQL = ("insert", "update", "delete", "drop", "alter", "create", "replace", "truncate", "attach", "detach", "pragma", "vacuum", "reindex", "grant", "revoke")
SUFFIXES = (".pdf", ".md", ".markdown", ".txt")

# Fixed value: the answer when the sources do not contain one.
NO_ANSWER = "I don't know based on the provided documents."
