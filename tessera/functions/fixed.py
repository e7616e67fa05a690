"""Fixed values that results depend on."""

# fixed values: words without a topic, in queries
COMMON_WORDS = ["the", "a", "an", "is", "in", "of", "to", "for", "with", "what", "how", "why", "explain", "describe", "compare", "difference"]

# fixed values: patterns that rule a keyword out, in order
REJECTED_TERMS = [
    r"^\d+$",
    r"^cid\s*\d+$",
    r"^overview\s+\d+$",
    r"^\d+\s+\d+$",
    r"^\d+m[ms]?$",
    r"^\d+(?:mm|cc|vdc|vac|psi|kg|lb|hz|khz|mhz|kv|kva|kw|kva)$",
    r"^[a-zA-Z]*\d+[a-zA-Z\d]*$",
    r"^_+.*|.*_+$",
    r"[<>#@*(){}\[\]\\]",
    r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b",
]

# fixed values: patterns of technical answers
TECHNICAL_TERMS = [
    r"(?i)\b(Experion\s+HS|Experion|CCC\s+(?:Connect|Inside)|ControlEdge|Honeywell\s+(?:Controller(?:s)?|Indicator(?:s)?|Set[-\s]?Point\s*Programmer(?:s)?|Universal\s*Digital\s*Controller|UDC\s*\d+|DC\s*\d+|DCP\s*\d+))\b",
    r"(?i)\b(SCADA|HMI|DCS|RTU|PLC|OPC\s*(?:UA|DA)|Modbus|PROFIBUS|EtherCAT)\b",
    r"(?i)\b(throughput\s+increase|recovery\s*rate|MTBF|MTTR)\b",
]

# fixed values: file types that are read
FILE_TYPES = ["pdf", "txt", "csv", "docx", "md"]
