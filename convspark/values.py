"""Enums, word lists, patterns and constants that results depend on."""

CHANNELS = ["chat", "email", "sms", "voice", "api"]
EVENT_TYPES = ["message_received", "document_uploaded", "status_changed", "anomaly_detected", "system_event"]
ACTION_TYPES = [
    "send_borrower_message",
    "notify_loan_officer",
    "schedule_call",
    "request_document",
    "update_status",
    "no_op",
]
DECISIONS = ["auto", "approval_required", "reject"]
ACTION_STATUSES = ["pending_policy", "pending_approval", "pending_exec", "executed", "rejected", "execution_failed"]
IDENTITY_KINDS = ["external_id", "email", "phone", "chat_handle"]  # lookup priority order

# payload key -> identity kind, in extraction order
IDENTITY_KEYS = [
    ("external_id", "external_id"),
    ("customer_external_id", "external_id"),
    ("from_email", "email"),
    ("email", "email"),
    ("sender_email", "email"),
    ("from_phone", "phone"),
    ("phone", "phone"),
    ("sender_phone", "phone"),
    ("chat_handle", "chat_handle"),
    ("user_handle", "chat_handle"),
    ("username", "chat_handle"),
]
DISPLAY_NAME_KEYS = ["display_name", "customer_name", "from_name", "sender_name"]

REQUEST_FIELDS = ["tenant_id", "customer_id", "channel_code", "event_type", "idempotency_key", "payload"]

# prompt-injection families: (flag, pattern, replacement); matched without regard to case
INJECTION_FAMILIES = [
    (
        "instruction_override",
        r"\b(ignore|disregard|forget|override)\b[^.\n]{0,40}\b(previous|prior|above|earlier|all)\b"
        r"[^.\n]{0,30}\b(instructions?|prompts?|rules?|directives?|messages?)\b",
        "[flagged: instruction-override phrase removed]",
    ),
    (
        "role_impersonation",
        r"((^|[\n.!?])\s*(system\s*:|assistant\s*:|user\s*:|role\s*:)"
        r"|<\|im_start\|>|<\|im_end\|>|<\|system\|>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)",
        " [flagged: role marker removed] ",
    ),
    (
        "system_prompt_leak",
        r"\b(reveal|show|print|repeat|leak|tell\s+me)\b[^.\n]{0,30}\b("
        r"your\s+(system\s+)?(prompt|instructions|rules)|the\s+(system\s+)?(prompt|instructions|rules))\b",
        "[flagged: system-prompt-leak request removed]",
    ),
    (
        "jailbreak_persona",
        r"\b(you\s+are\s+now|act\s+as|pretend\s+to\s+be|roleplay\s+as)\b[^.\n]{0,60}\b("
        r"dan|developer[\s\-_]+mode|jailbroken|unrestricted|"
        r"without\s+(any\s+)?(restrictions|rules|filters|limits|filters?|limits?)|"
        r"with\s+no\s+(restrictions|rules|filters|limits)|no\s+(restrictions|rules|filters|limits))\b",
        "[flagged: jailbreak persona removed]",
    ),
    (
        "delimiter_abuse",
        r"(```(system|user|assistant|prompt|instructions)\b|<system>|</system>|<prompt>|</prompt>)",
        "[flagged: delimiter removed]",
    ),
    (
        "policy_override",
        r"\b(skip|bypass|override|disable|ignore)\b[^.\n]{0,30}\b("
        r"approval|compliance|policy|policies|review|audit|human\s+in\s+the\s+loop|verification)\b",
        "[flagged: policy-override phrase removed]",
    ),
]
BEGIN_UNTRUSTED = "<<<BEGIN_UNTRUSTED_CUSTOMER_CONTENT>>>"
END_UNTRUSTED = "<<<END_UNTRUSTED_CUSTOMER_CONTENT>>>"

# retrieval constants
EMBED_BUCKETS = 4096
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
SUMMARY_BAND = 1e18
ACTION_BAND = 1e12
WARM_BAND = 1e6
TIME_TIEBREAK = 1e-12
RERANK_WEIGHTS = {"cosine": 1.0, "bigram": 0.7, "jaccard": 0.4, "recency": 0.2}
RERANK_TOP_K = 30
HALF_LIFE_DAYS = 30.0
SUMMARY_CHARS = 200
SUMMARY_SUFFIX = "...[mock-summary]"
ECHO_PREFIX = "[mock-llm] "
DEFAULT_BUDGET = 8000
NAIVE_BUDGET = 50000

# recall stopwords
STOPWORDS = (
    "the and for you are was but can with this that from have has had his her him she they them their your yours "
    "ours what when where why how who whom which into out all any not nor yet such than then thus now would could "
    "should will shall may might must been being were did does doing done very just much more most some few many "
    "every each either neither both other another here there back down over under above below before after again "
    "off yes no"
).split()
SCORE_THRESHOLDS = [0.20, 0.40, 0.60, 0.80]

LENGTH_BUCKETS = [("short", 10, 30), ("medium", 31, 100), ("long", 101, 300), ("very_long", 301, 500)]
FACT_INTENTS = [
    "rate_lookup",
    "checklist_followup",
    "status_check",
    "refi_question",
    "closing_logistics",
    "handoff_followup",
    "preapproval_expiry",
    "appraisal_outcome",
    "down_payment_breakdown",
    "pmi_question",
]
NO_TRUTH = "(no system response in source dialogue — judge against history coherence only)"

# proposal rules
FALLBACK_ACTIONS = {
    "message_received": "send_borrower_message",
    "document_uploaded": "update_status",
    "status_changed": "notify_loan_officer",
    "anomaly_detected": "notify_loan_officer",
    "system_event": "no_op",
}
FALLBACK_DEFAULT = "notify_loan_officer"
NAIVE_DECISIONS = {
    "message_received": "auto",
    "document_uploaded": "approval_required",
    "status_changed": "approval_required",
    "anomaly_detected": "approval_required",
    "system_event": "auto",
}
SAFE_DECISION = "approval_required"

# prompt lengths enter the token counters, so the wording is fixed
JUDGE_SYSTEM_PROMPT = """\
You are a strict policy evaluator for a customer-service AI system.

You will receive a tenant's policy as a JSON object mapping action
types to decisions, plus a proposed action. Look up the exact
action_type in the policy table. If absent, use the "default" key. If
"default" is absent, return "approval_required" (the safe default).

Respond with EXACTLY a JSON object of the shape:
  {"decision": "<auto|approval_required|reject>", "reasoning": "<short>"}

No prose, no markdown fences, no preamble."""
NAIVE_SYSTEM_PROMPT = """\
You are a customer-service AI policy engine. Given a tenant's policy
described in English and a proposed action, decide whether the action
should auto-execute, require human approval, or be rejected outright.

Respond with the single word "auto", "approval_required", or
"reject", followed by one short sentence explaining why."""
JUDGE_OUTPUT_TOKENS = 32

# prices, USD per million tokens
USD_PER_M_INPUT = 3.0
USD_PER_M_OUTPUT = 15.0
SYSTEM_PROMPT_TOKENS = 200
RESPONSE_TOKENS = 180
PROD_INPUT_TOKENS = 1500
PROD_OUTPUT_TOKENS = 80

# strategy -> (auditability, maintainability), 1-5
RUBRIC = {
    "declarative": (5, 5),
    "python_rules": (3, 2),
    "naive_llm": (2, 4),
    "llm_judge": (4, 4),
}

EXACT_SIMILARITY = 1.0 - 1e-9
