"""Limits, word lists, patterns and message formats the results depend on."""

# --- fixed values: roles of the message log ---------------------------------
USER = "user"
ASSISTANT = "assistant"
TOOL_LOG = "tool_log"
EVALUATOR_LOG = "evaluator_log"
GUARDRAIL_LOG = "guardrail_log"

# --- fixed values: limits ---------------------------------------------------
MAX_RETRIES = 3
MAX_WORDS = 100
RATE_LIMIT = 20
RATE_WINDOW_SECONDS = 300
ACTIVE_DAYS = 14
TOP_QUESTIONS = 8
PREVIEW_CHARS = 120
SESSION_PREFIX_CHARS = 8
DRAFT_CHARS = 500
HISTORY_LOOKBACK = 8

# --- fixed values: tool names -----------------------------------------------
RECORD_DETAILS = "record_user_details"
RECORD_UNKNOWN = "record_unknown_question"
RECORD_FEEDBACK = "record_feedback_tool"
CHECK_AVAILABILITY = "check_availability_tool"
SCHEDULE_CALL = "schedule_call_tool"
CREATE_CHECKLIST = "create_checklist"
MARK_COMPLETE = "mark_complete"

OPERATIONAL_TOOLS = [CHECK_AVAILABILITY, SCHEDULE_CALL, RECORD_DETAILS, RECORD_FEEDBACK]

# --- fixed values: tool arguments (tool, argument, JSON type, required) ------
TOOL_ARGUMENTS = [
    (RECORD_DETAILS, "email", "string", True),
    (RECORD_DETAILS, "name", "string", False),
    (RECORD_DETAILS, "notes", "string", False),
    (RECORD_UNKNOWN, "question", "string", True),
    (RECORD_FEEDBACK, "rating", "integer", True),
    (RECORD_FEEDBACK, "comment", "string", False),
    (CHECK_AVAILABILITY, "date", "string", True),
    (CHECK_AVAILABILITY, "time_preference", "string", False),
    (SCHEDULE_CALL, "email", "string", True),
    (SCHEDULE_CALL, "date", "string", True),
    (SCHEDULE_CALL, "time", "string", True),
    (SCHEDULE_CALL, "name", "string", False),
    (CREATE_CHECKLIST, "descriptions", "array of string", True),
    (MARK_COMPLETE, "index", "integer", True),
    (MARK_COMPLETE, "completion_notes", "string", True),
]

# --- fixed values: defaults of optional tool arguments ------------------------
DEFAULT_NAME = "Name not provided"
DEFAULT_NOTES = "not provided"
DEFAULT_COMMENT = ""
DEFAULT_TIME_PREFERENCE = "any"

# --- fixed values: unsafe-message patterns -------------------------------------
UNSAFE_PATTERNS = [
    r"ignore (all )?(previous|prior|above) instructions",
    r"olvid[aá].*instrucciones",
    r"system prompt",
    r"(show|reveal|print|dump).*(prompt|instructions)",
    r"act[uú]a como (chatgpt|un asistente|assistant)",
    r"jailbreak",
    r"<\s*/?\s*system\s*>",
]

# words, in lower case, one of which occurs in every text that matches a pattern above
UNSAFE_NEEDLES = [
    "instructions", "instrucciones", "prompt", "a como ", "jailbreak", "system",
]

# --- fixed values: answer-rule patterns ----------------------------------------
AGE_QUESTION = r"\b(edad|años|año|cuántos años|cuantos años|how old|age|nació|nacimiento|birth)\b"
AGE_CLAIMS = [
    r"\b\d{1,2}\s*años\b",
    r"\bnació en \d{4}\b",
    r"\btiene \d{1,2}\b",
    r"\bborn in \d{4}\b",
    r"\b\d{1,2}\s*years?\s*old\b",
    r"\bi'?m\s*\d{1,2}\b",
    r"\bborn\s*(in|on)?\s*\d{4}\b",
]
AGE_IN_CONTEXT = (
    r"\b(edad|nació|nacimiento|born|years old|age)\b"
    r"|\baños\b(?!\s*(de\s*)?(experiencia|trabajando|en\s))"
)
# one of these is in every text that AGE_IN_CONTEXT matches
AGE_CONTEXT_NEEDLES = ["edad", "naci", "born", "years old", "age", "años"]
UNSURE = (
    r"\b(no (lo )?s[eé]|no tengo|no figure|no consta|no está|no disponible|"
    r"don't know|not in my profile)\b"
)

# --- fixed values: scheduling and contact hints ----------------------------------
OPERATIONAL_HINTS = [
    "llamada", "call", "agendar", "disponib", "horario", "reunión", "reunion",
    "meeting", "schedule", "correo", "email", "@", "programar", "coordin",
]

# --- fixed values: message formats (printf style) ----------------------------------
FEEDBACK_OPERATIONAL_LENGTH = (
    "Response is %d words; keep confirmation under %d. Be brief: date, time, email, done."
)
FEEDBACK_LENGTH = "Response is %d words; keep it under %d. Rewrite in 2-4 short sentences."
FEEDBACK_AGE = (
    "Age/birth year is not in approved context. Do NOT invent. "
    "Call record_unknown_question, then say that info is not in your profile."
)
FEEDBACK_MISSING_TOOL = (
    "You indicated missing info but did not call record_unknown_question. "
    "Call the tool first, then tell the user the fact is not in your profile."
)
FEEDBACK_UNVERIFIED = (
    "Evaluator could not verify grounding. Reply only with approved context facts."
)
REPLY_BLOCKED = (
    "Lo siento, no puedo procesar ese mensaje. "
    "¿Hay algo relacionado a mi carrera que querés saber?"
)
REPLY_RATE_LIMITED = "Estás enviando muchos mensajes seguidos. Probá de nuevo en unos minutos."
NO_CHECKLIST = "No checklist items yet."
BAD_CHECKLIST_INDEX = "No checklist at this index."

NOTICE_LEAD = "Recording interest from %s with email %s and notes %s"
NOTICE_UNKNOWN = "Recording %s asked that I couldn't answer"
NOTICE_FEEDBACK = "Feedback recibido: %s/5 - %s"
NOTICE_AVAILABILITY = "Consulta de disponibilidad: %s (preferencia: %s)"
NOTICE_BOOKING = "Call agendada con %s (%s) — %s a las %s"
NOTICE_RATE_LIMIT = "⚠️ Rate limit: session %s..."
NOTICE_UNSAFE = "⚠️ Mensaje sospechoso bloqueado: %s"

LABEL_MESSAGES = "Mensajes"
LABEL_SESSIONS = "Sesiones"
