"""Fixed patterns and word lists used to recognise kinds of text."""

from __future__ import annotations

# Whole-value patterns.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^\+?1?-?\.?\s?\(?(\d{3})\)?[-.\s]?(\d{3})[-.\s]?(\d{4})$"
DATES = [r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}-\d{2}-\d{4}$"]
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
ALPHANUMERIC = r"^[\p{L}\p{N}]+$"

# Column-name parts that mark sensitive data.
SENSITIVE_NAMES = [
    "ssn", "social", "security", "passport", "license", "credit",
    "card", "account", "bank", "routing", "pin", "password",
    "email", "phone", "address", "name", "birth", "age",
]

# Column-name parts hidden in a preview.
PREVIEW_NAMES = ["name", "email", "phone", "address", "id"]

# Texts read as null.
NULL_TOKENS = ["", "NULL", "null", "N/A", "n/a", "NA", "na"]

# Byte patterns that make a file suspicious.
SUSPICIOUS = ["<script", "javascript:", "eval(", "exec(", "cmd.exe", "powershell"]

# What each expected type name accepts.
TYPE_NAMES = {
    "int64": ["integer", "int", "numeric"],
    "float64": ["float", "numeric", "decimal"],
    "object": ["string", "text", "categorical"],
    "bool": ["boolean", "bool"],
    "datetime64": ["datetime", "date", "timestamp"],
}
