"""Rule data: lexicons, intents, thresholds, scripts and messages.

Everything in this module is a fixed value: the words, numbers, patterns and
message texts that an analysis must use to give the expected results.  No
logic lives here; every operator takes its rules as a parameter and only
defaults to these.
"""

from __future__ import annotations

# --- fixed values: sentiment lexicons -------------------------------------

FALLBACK_SENTIMENT = {
    "positive": ["good", "great", "thank", "helpful", "satisfied", "excellent", "wonderful"],
    "negative": ["bad", "terrible", "awful", "frustrated", "angry", "upset", "disappointed"],
}
LEGACY_SENTIMENT = {
    "positive": ["good", "great", "thank", "helpful", "satisfied"],
    "negative": ["bad", "terrible", "rude", "wait", "frustrated"],
}
QUICK_SENTIMENT = {
    "positive": ["good", "great", "thank", "helpful", "excellent", "satisfied", "appreciate"],
    "negative": ["bad", "terrible", "awful", "frustrated", "angry", "upset", "disappointed"],
}
LEGACY_QUICK_SENTIMENT = {
    "positive": ["good", "great", "thank", "helpful", "excellent", "satisfied"],
    "negative": ["bad", "terrible", "awful", "frustrated", "angry", "upset"],
}
SEGMENT_SENTIMENT = {
    "positive": ["good", "great", "thank", "yes", "sure", "perfect"],
    "negative": ["no", "bad", "terrible", "problem", "issue", "wrong"],
}

# --- fixed values: keyword intents and urgency of the rule-only insight ----

FALLBACK_INTENTS = {
    "appointment_booking": ["appointment", "schedule", "book", "available"],
    "emergency": ["emergency", "urgent", "pain", "bleeding"],
    "pricing": ["cost", "price", "insurance", "payment"],
    "complaint": ["complaint", "problem", "issue", "dissatisfied"],
}
FALLBACK_URGENCY = {
    "critical": ["urgent", "emergency", "asap", "immediately"],
    "elevated": ["soon", "quickly", "prefer"],
}
COACHING_URGENCY = {
    "critical": ["emergency", "urgent", "asap", "immediately", "can't wait"],
    "elevated": ["soon", "quickly", "right away", "need"],
}

# --- fixed values: intent rules, in the order that decides ties ------------

INTENTS = {
    "appointment_booking": {
        "keywords": ["appointment", "schedule", "book", "reserve", "available", "when can",
                     "slot", "time", "date", "calendar", "booking"],
        "phrases": ["book an appointment", "schedule appointment", "make appointment",
                    "available times", "when can I come", "appointment slot", "reserve time",
                    "schedule visit"],
        "patterns": [r"(?:book|schedule|make).*appointment",
                     r"(?:when|what time).*(?:available|come|visit)",
                     r"(?:available|free).*(?:time|slot|appointment)",
                     r"(?:appointment|visit).*(?:today|tomorrow|next week)"],
        "boost": 0.3,
    },
    "appointment_cancellation": {
        "keywords": ["cancel", "cancellation", "reschedule", "postpone", "change", "move",
                     "different time", "cannot make"],
        "phrases": ["cancel appointment", "cancel my appointment", "reschedule appointment",
                    "change appointment", "move appointment", "cannot make it"],
        "patterns": [r"(?:cancel|reschedule|change|move).*appointment",
                     r"(?:cannot|can't|unable).*(?:make|come|attend)",
                     r"(?:postpone|delay).*(?:appointment|visit)"],
        "boost": 0.2,
    },
    "emergency_dental": {
        "keywords": ["emergency", "urgent", "pain", "severe", "immediate", "asap", "right now",
                     "help", "hurt", "ache", "bleeding"],
        "phrases": ["dental emergency", "urgent care", "severe pain", "tooth pain", "need help",
                    "hurts badly", "emergency appointment"],
        "patterns": [r"(?:emergency|urgent|immediate).*(?:dental|tooth|care)",
                     r"(?:severe|bad|terrible).*(?:pain|ache|hurt)",
                     r"(?:need|require).*(?:immediate|urgent|asap)",
                     r"(?:bleeding|swollen|infected).*(?:tooth|gum|mouth)"],
        "boost": 0.4,
    },
    "insurance_inquiry": {
        "keywords": ["insurance", "coverage", "benefits", "claim", "copay", "deductible",
                     "in-network", "covered", "cost", "price"],
        "phrases": ["insurance coverage", "dental benefits", "how much cost",
                    "covered by insurance", "file claim", "copay amount"],
        "patterns": [r"(?:insurance|coverage|benefits).*(?:cover|pay|include)",
                     r"(?:how much|cost|price|expense).*(?:procedure|treatment)",
                     r"(?:copay|deductible|out of pocket).*(?:amount|cost)",
                     r"(?:in-network|covered|accepted).*(?:provider|insurance)"],
        "boost": 0.25,
    },
    "treatment_inquiry": {
        "keywords": ["treatment", "procedure", "cleaning", "filling", "crown", "root canal",
                     "extraction", "whitening", "implant", "what is"],
        "phrases": ["what is procedure", "how does treatment work", "procedure information",
                    "treatment options", "what involves", "procedure steps"],
        "patterns": [r"(?:what is|explain|tell me about).*(?:procedure|treatment)",
                     r"(?:how does|how long).*(?:procedure|treatment|process)",
                     r"(?:treatment|procedure).*(?:options|available|possible)",
                     r"(?:need|require|recommend).*(?:treatment|procedure)"],
        "boost": 0.2,
    },
    "complaint": {
        "keywords": ["complaint", "dissatisfied", "unhappy", "problem", "issue", "disappointed",
                     "poor service", "bad experience", "wrong"],
        "phrases": ["file complaint", "not satisfied", "poor service", "bad experience",
                    "something wrong", "not happy", "disappointed with"],
        "patterns": [r"(?:complaint|complain|issue|problem).*(?:service|treatment|experience)",
                     r"(?:not|un)(?:satisfied|happy).*(?:with|about)",
                     r"(?:poor|bad|terrible).*(?:service|experience|treatment)",
                     r"(?:disappointed|upset|frustrated).*(?:with|about)"],
        "boost": 0.3,
    },
    "billing_inquiry": {
        "keywords": ["billing", "bill", "payment", "charge", "invoice", "account", "balance",
                     "owe", "paid", "receipt"],
        "phrases": ["billing question", "payment information", "account balance",
                    "invoice details", "charge explanation", "payment plan"],
        "patterns": [r"(?:billing|bill|invoice|charge).*(?:question|inquiry|problem)",
                     r"(?:payment|pay).*(?:plan|option|method|schedule)",
                     r"(?:account|balance).*(?:information|status|inquiry)",
                     r"(?:owe|charged|cost).*(?:how much|amount)"],
        "boost": 0.2,
    },
    "follow_up": {
        "keywords": ["follow up", "check back", "after treatment", "post procedure", "recovery",
                     "healing", "progress", "how am I doing"],
        "phrases": ["follow up appointment", "check progress", "after procedure",
                    "recovery status", "healing well", "post treatment"],
        "patterns": [r"(?:follow up|check back|follow-up).*(?:appointment|visit|call)",
                     r"(?:after|post).*(?:treatment|procedure|surgery)",
                     r"(?:recovery|healing).*(?:progress|status|how)",
                     r"(?:check|see how).*(?:doing|healing|recovering)"],
        "boost": 0.2,
    },
    "general_inquiry": {
        "keywords": ["information", "question", "ask", "wondering", "curious", "tell me",
                     "explain", "help", "service", "hours"],
        "phrases": ["general question", "information about", "office hours", "services offered",
                    "location information", "contact information"],
        "patterns": [r"(?:information|info|details).*(?:about|regarding)",
                     r"(?:office|clinic).*(?:hours|location|address)",
                     r"(?:services|treatments).*(?:offered|available|provide)",
                     r"(?:general|simple).*(?:question|inquiry)"],
        "boost": 0.1,
    },
}
INTENT_WEIGHTS = {"keywords": 0.4, "phrases": 0.5, "patterns": 0.6}
INTENT_THRESHOLD = 0.3
DEFAULT_INTENT = "general_inquiry"

# context flag -> (intent that gains, gain)
CONTEXT_GAINS = {
    "time_mentioned": ("appointment_booking", 0.1),
    "previous_appointment": ("follow_up", 0.15),
    "recent_treatment": ("follow_up", 0.1),
    "billing_issues": ("billing_inquiry", 0.1),
}

URGENCY_LABELS = {
    "high": ["emergency", "urgent", "asap", "immediately", "right now", "severe pain",
             "bleeding", "swollen", "infected", "can't eat"],
    "medium": ["soon", "today", "this week", "pain", "uncomfortable", "bothering", "sensitive",
               "worried"],
    "low": ["when convenient", "sometime", "eventually", "routine", "checkup", "cleaning",
            "non-urgent"],
}

# --- fixed values: entities --------------------------------------------------

CLOCK_TIME = r"\b(?:1[0-2]|[1-9])(?::[0-5][0-9])?\s*(?:am|pm|AM|PM)\b"
DAY_PART = r"\b(?:morning|afternoon|evening|noon)\b"
WEEKDAY = r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
RELATIVE_DAY = r"\b(?:today|tomorrow|next week|this week)\b"
WEEKDAY_OR_RELATIVE = (r"\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|today|"
                       r"tomorrow|next week|this week)\b")
MONTH_DAY = (r"\b(?:january|february|march|april|may|june|july|august|september|october|"
             r"november|december)\s+\d{1,2}(?:st|nd|rd|th)?\b")
SLASH_DATE = r"\b\d{1,2}\/\d{1,2}\/\d{2,4}\b"
PAIN_PATTERNS = [
    r"(?:severe|terrible|unbearable|excruciating)\s*pain",
    r"pain\s*(?:level|scale)\s*(?:[0-9]|ten)",
    r"(?:throbbing|sharp|dull)\s*(?:pain|ache)",
]
PHONE_PATTERNS = [
    r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    r"\(\d{3}\)\s*\d{3}[-.]?\d{4}",
    r"\b\d{3}\s\d{3}\s\d{4}\b",
]
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
# token-shape rules written as regexes: label -> pattern
TOKEN_PATTERNS = {
    "PHONE_0": r"\b\d{3}-\d{3}-\d{4}\b",
    "PHONE_1": r"\(\s?\d{3}\s?\)\s?\d{3}\s?-\s?\d{4}\b",
    "PHONE_2": r"\b\d{3}\s\d{3}\s\d{4}\b",
    "TIME_0": r"(?i)(?<![\d:])\d\s?(?:am|pm)\b",
    "TIME_1": r"(?i)(?<![\d:])\d{2}\s?(?:am|pm)\b",
    "TIME_2": r"(?i)(?<![\d:])\d:\d{2}\s?(?:am|pm)\b",
    "TIME_3": r"(?i)(?<![\d:])\d{2}:\d{2}\s?(?:am|pm)\b",
    "INSURANCE_0": r"(?i)\bblue\s+cross\b",
    "INSURANCE_1": r"(?i)\baetna\b",
    "INSURANCE_2": r"(?i)\bcigna\b",
    "INSURANCE_3": r"(?i)\bhumana\b",
    "INSURANCE_4": r"(?i)\bmetlife\b",
    "INSURANCE_5": r"(?i)\bdelta\s+dental\b",
}
ENTITY_CONFIDENCE = {"PHONE": 0.9, "EMAIL": 0.95, "TOKEN": 0.9, "PHRASE": 0.8, "TERM": 0.5}
CONTEXT_CHARS = 50

SYMPTOM_WORDS = ["bleeding", "swollen", "infected", "pus", "fever", "numbness"]
INTENT_PROVIDERS = ["blue cross", "blue shield", "aetna", "cigna", "humana", "metlife",
                    "delta dental", "guardian", "principal"]
INTENT_COVERAGE_TERMS = ["copay", "deductible", "coverage", "benefits", "claim"]
TREATMENTS = ["cleaning", "checkup", "filling", "crown", "root canal", "extraction",
              "whitening", "implant", "braces", "surgery"]
INSURANCE_PROVIDERS = ["blue cross", "blue shield", "aetna", "cigna", "humana", "metlife",
                       "delta dental", "guardian", "principal", "united healthcare", "anthem"]
INSURANCE_TERMS = ["insurance", "coverage", "benefits", "copay", "deductible", "claim",
                   "pre-authorization", "in-network", "out-of-network"]
SCHEDULING_WORDS = ["schedule", "book", "appointment", "available", "when can"]

MEDICAL_TERMS = {
    "procedures": ["cleaning", "checkup", "examination", "x-ray", "filling", "crown",
                   "root canal", "extraction", "implant", "bridge", "dentures", "whitening",
                   "scaling", "polishing", "fluoride treatment", "periodontal", "endodontic",
                   "orthodontic", "oral surgery"],
    "conditions": ["cavity", "caries", "gingivitis", "periodontitis", "plaque", "tartar",
                   "abscess", "infection", "sensitivity", "toothache", "gum disease",
                   "tooth decay", "bad breath", "dry mouth", "TMJ", "bruxism", "malocclusion"],
    "symptoms": ["pain", "ache", "swelling", "bleeding", "sensitivity", "discomfort",
                 "throbbing", "sharp pain", "dull ache", "tender", "sore", "inflammation",
                 "irritation"],
    "anatomy": ["tooth", "teeth", "molar", "incisor", "canine", "premolar", "gum", "gums",
                "jaw", "tongue", "mouth", "bite", "enamel", "dentin", "pulp", "nerve", "root",
                "crown"],
}

# --- fixed values: topics -----------------------------------------------------

TOPICS = {
    "appointment_scheduling": ["appointment", "schedule", "book", "available", "time", "date",
                               "calendar", "slot", "booking", "reschedule", "cancel"],
    "emergency_dental": ["emergency", "urgent", "pain", "severe", "bleeding", "accident",
                         "immediate", "asap", "help", "urgent care"],
    "insurance_billing": ["insurance", "coverage", "benefits", "claim", "copay", "deductible",
                          "billing", "payment", "cost", "price", "charge"],
    "dental_procedures": ["cleaning", "checkup", "filling", "crown", "root canal", "extraction",
                          "whitening", "implant", "surgery", "treatment", "procedure"],
    "patient_concerns": ["worried", "concerned", "anxious", "scared", "nervous", "question",
                         "problem", "issue", "complaint", "dissatisfied"],
    "follow_up": ["follow up", "check back", "return", "next visit", "callback",
                  "post treatment", "recovery", "healing", "progress"],
}
FILLER_STOP_WORDS = ["um", "uh", "oh", "yeah", "yes", "no", "okay", "ok", "sure", "hello", "hi",
                     "thank", "thanks", "please", "sorry"]

# --- fixed values: business phrases of a whole call ---------------------------

URGENCY_PHRASES = ["emergency", "urgent", "asap", "immediately", "right away", "severe pain",
                   "bleeding", "can't wait", "need help now", "very important", "critical",
                   "serious"]
SATISFACTION_PHRASES = ["thank you", "appreciate", "helpful", "great service", "satisfied",
                        "excellent", "professional", "friendly", "frustrated", "disappointed",
                        "terrible", "awful", "unhappy", "dissatisfied", "poor service", "rude"]
CONVERSION_PHRASES = ["book appointment", "schedule", "when can I come in",
                      "what times available", "sign me up", "interested in",
                      "how much does it cost", "insurance cover", "payment plan"]

# --- fixed values: coaching ------------------------------------------------------

CONCERNS = {
    "pricing": ["price", "cost", "expensive", "afford", "money", "payment"],
    "availability": ["available", "schedule", "appointment", "book", "when"],
    "insurance": ["insurance", "coverage", "benefits", "copay"],
    "pain": ["pain", "hurt", "ache", "discomfort", "sore"],
    "quality": ["quality", "previous", "last time", "before"],
    "wait_time": ["wait", "long", "delay", "time"],
}
LEGACY_CONCERNS = {
    "pricing": ["price", "cost", "expensive", "afford"],
    "availability": ["available", "schedule", "appointment", "booking"],
    "insurance": ["insurance", "coverage", "benefits"],
    "medical_urgency": ["pain", "hurt", "emergency", "urgent"],
}
CLOSING_WORDS = ["thank", "bye", "goodbye", "have a great"]
RESPONDING_WORDS = ["let me", "i'll", "i can"]
EMPATHY_WORDS = ["understand", "sorry", "apologize", "feel", "appreciate"]
UNPROFESSIONAL_WORDS = ["um", "uh", "like", "you know", "whatever"]
KNOWLEDGE_WORDS = ["we offer", "i can help", "let me explain", "the process"]
HIGH_EMOTION_WORDS = ["very", "really", "extremely", "absolutely"]
SATISFIED_WORDS = ["good", "great", "thank", "appreciate"]
DISSATISFIED_WORDS = ["bad", "terrible", "frustrated", "upset"]
ALERT_WORDS = {
    "customer_emotion": ["frustrated", "angry", "upset", "terrible", "awful", "ridiculous"],
    "emergency": ["emergency", "severe pain", "bleeding", "accident", "urgent", "can't wait"],
    "legal": ["lawyer", "legal action", "sue", "complaint", "better business bureau"],
}
UPSELL_WORDS = ["cleaning", "checkup"]
RESOLUTION_PHRASES = ["let me", "i'll check", "one moment"]
REPEATED_FRUSTRATION = ["frustrated", "angry", "upset", "ridiculous", "unacceptable"]
LEGAL_RISK_WORDS = ["lawyer", "legal", "sue", "complaint", "report", "review"]
SUPERVISOR_WORDS = ["supervisor", "manager", "someone else", "higher up"]

COACHING = {
    "sentiment": QUICK_SENTIMENT,
    "concerns": CONCERNS,
    "urgency": COACHING_URGENCY,
    "closing": CLOSING_WORDS,
    "responding": RESPONDING_WORDS,
    "empathy": EMPATHY_WORDS,
    "unprofessional": UNPROFESSIONAL_WORDS,
    "knowledge": KNOWLEDGE_WORDS,
    "emotion": HIGH_EMOTION_WORDS,
    "satisfied": SATISFIED_WORDS,
    "dissatisfied": DISSATISFIED_WORDS,
    "alert_words": ALERT_WORDS,
    "upsell": UPSELL_WORDS,
    "resolution": RESOLUTION_PHRASES,
    "frustration": REPEATED_FRUSTRATION,
    "legal_risk": LEGAL_RISK_WORDS,
    "supervisor": SUPERVISOR_WORDS,
    "sentiment_drop": -0.3,
    "sentiment_critical": -0.7,
    "duration_warning": 600,
    "duration_critical": 900,
    "upsell_sentiment": 0.3,
    "upsell_after_chunks": 5,
    "resolution_limit": 4,
    "resolution_after_chunks": 15,
    "frustration_limit": 2,
    "listening_stage": "customer_speaking",
    "listening_every_chunks": 3,
    "solving_stage": "problem_solving",
    "solving_concern": "problem",
    "resolution_stage": "resolution",
    "closing_after_chunks": 10,
    "upset_emotion": "upset",
    "scope": "chunk",
    "empathy_once": True,
}
LEGACY_COACHING = {
    **COACHING,
    "sentiment": LEGACY_QUICK_SENTIMENT,
    "concerns": LEGACY_CONCERNS,
    "closing": ["thank", "bye", "goodbye"],
    "empathy": ["understand", "sorry", "apologize"],
    "unprofessional": ["um", "uh", "like"],
    "alert_words": {
        "customer_emotion": ["frustrated", "angry", "upset", "terrible", "awful"],
        "emergency": ["emergency", "severe pain", "bleeding", "accident", "urgent"],
    },
    "upsell": ["cleaning"],
    "resolution": ["let me"],
    "frustration": ["frustrated", "angry", "upset"],
    "legal_risk": ["lawyer", "legal", "sue", "complaint", "report"],
    "sentiment_drop": -0.3,
    "duration_critical": 900,
    "supervisor": [],
    "sentiment_critical": None,
    "duration_warning": None,
    "upsell_after_chunks": 0,
    "resolution_limit": 3,
    "resolution_after_chunks": 0,
    "listening_stage": "question",
    "listening_every_chunks": 1,
    "closing_after_chunks": 0,
    "deescalation_sentiment": -0.2,
    "scope": "buffer",
    "empathy_once": False,
}
COACHING_PROFILES = {"default": COACHING, "legacy": LEGACY_COACHING}
START_SCORE = 0.5
SCORE_KEEP = 0.8
SCORES = ["empathy", "efficiency", "knowledge", "professionalism"]

# category -> (type, priority, message, suggested action)
ALERT_TEXTS = {
    "sentiment_critical": ("critical", "sentiment", "high",
        "🚨 CRITICAL SENTIMENT ALERT: Customer satisfaction critically low (%.2f). Immediate intervention required.",
        "Consider apologizing, acknowledging concerns, and offering to escalate to supervisor."),
    "sentiment_warning": ("warning", "sentiment", "medium",
        "⚠️ SENTIMENT WARNING: Customer satisfaction declining (%.2f). Use empathy techniques.",
        "Acknowledge customer feelings and show understanding."),
    "duration_critical": ("critical", "duration", "high",
        "⏰ DURATION CRITICAL: Call exceeding %.0f minutes. Consider wrap-up.",
        "Summarize next steps and schedule follow-up if needed."),
    "duration_warning": ("warning", "duration", "medium",
        "⏰ DURATION WARNING: Call running long (%.0f minutes). Monitor progress.",
        "Ensure conversation stays focused on resolution."),
    "customer_emotion": ("warning", "customer_emotion", "high",
        "😤 FRUSTRATION DETECTED: Customer expressing negative emotions.",
        "Use de-escalation techniques: acknowledge, empathize, and focus on solutions."),
    "emergency": ("critical", "emergency", "critical",
        "🚨 EMERGENCY INDICATORS: Urgent medical situation detected.",
        "Prioritize immediate scheduling. Follow emergency protocols."),
    "legal": ("critical", "legal", "critical",
        "⚖️ LEGAL LANGUAGE DETECTED: Customer mentioned legal action.",
        "Escalate to management immediately. Document everything carefully."),
}
# type -> (message, script example, timing)
SUGGESTION_TEXTS = {
    "empathy": ("💝 EMPATHY OPPORTUNITY: Customer seems concerned. Try acknowledging their feelings.",
        "I understand your concern about [specific issue]. Let me help you with that.", "immediate"),
    "active_listening": ("👂 ACTIVE LISTENING: Let customer finish, then summarize what you heard.",
        "Let me make sure I understand correctly. You're saying that...", "after_customer_finishes"),
    "solution_focus": ("🎯 SOLUTION FOCUS: Move toward resolution. Ask what would make this right.",
        "What would be the best outcome for you in this situation?", "immediate"),
    "closing": ("🏁 CLOSING OPPORTUNITY: Summarize agreements and confirm next steps.",
        "Let me confirm what we've agreed on today...", "immediate"),
    "upsell": ("💰 UPSELL OPPORTUNITY: Customer is satisfied. Consider mentioning additional services.",
        "While you're here, we could also take a look at...", "when_appropriate"),
}
# concern -> (category, situation, script, follow-up question)
SCRIPT_TEXTS = {
    "pricing": ("pricing", "Customer concerned about cost",
        "I understand cost is important. We offer flexible payment plans, and I can have our treatment coordinator discuss options that work within your budget.",
        "Would you like me to schedule a consultation to go over the options?"),
    "availability": ("scheduling", "Customer needs appointment soon",
        "Let me check our schedule for the next few weeks. We also maintain a cancellation list if you'd like to be contacted about earlier openings.",
        "What days and times work best for you?"),
    "insurance": ("insurance", "Insurance coverage questions",
        "We work with most major insurance plans and handle direct billing. I can verify your coverage right now and provide an estimate before your visit.",
        "Can you provide me with your insurance information?"),
    "pain": ("medical", "Customer in pain or discomfort",
        "I'm sorry to hear you're experiencing discomfort. Let's get you scheduled as soon as possible. We have emergency slots available.",
        "Can you describe the type of pain you're experiencing?"),
    "upset": ("de_escalation", "Customer is upset or frustrated",
        "I sincerely apologize for the frustration this has caused you. Your experience is very important to us, and I want to make this right.",
        "What can I do to resolve this for you today?"),
}
# type -> (message, reason, urgency)
ESCALATION_TEXTS = {
    "resolution_difficulty": ("ESCALATION SUGGESTED: Multiple resolution attempts (%d) without clear progress.",
        "Complex issue requiring supervisor expertise", "medium"),
    "customer_frustration": ("ESCALATION REQUIRED: Customer expressing repeated frustration.",
        "High risk of customer dissatisfaction", "high"),
    "legal_risk": ("ESCALATION CRITICAL: Legal language detected.",
        "Potential legal or compliance risk", "critical"),
    "supervisor_requested": ("ESCALATION REQUESTED: Customer asking for supervisor.",
        "Direct customer request", "high"),
}
# score -> (area when low, strength when high, course for the area)
SCORE_TEXTS = {
    "empathy": ("Empathy and emotional connection with customers",
                "Excellent empathy and customer connection",
                "Customer Service Excellence Training"),
    "efficiency": ("Call efficiency and time management",
                   "Efficient call handling and time management",
                   "Efficient Call Handling Workshop"),
    "knowledge": ("Product and service knowledge",
                  "Strong product and service knowledge",
                  "Product Knowledge Refresher Course"),
    "professionalism": ("Professional communication and language",
                        "Professional communication style",
                        "Professional Communication Skills Training"),
}
SENTIMENT_AREA = ("Customer satisfaction and relationship management",
                  "Customer Relationship Management Training")
LOW_SCORE = 0.7
HIGH_SCORE = 0.8

STAFF_BASELINE = {
    "avg_sentiment": 0.5, "avg_resolution_rate": 0.8, "avg_call_duration": 300.0,
    "empathy": 0.7, "efficiency": 0.7, "knowledge": 0.7, "professionalism": 0.8,
}
OPENING_TIPS = [
    "Use the customer's name during the conversation to build rapport",
    "Ask open-ended questions to fully understand their needs",
    "Listen actively and acknowledge their concerns before proposing solutions",
]
CONTEXT_TIPS = {
    "is_new_patient": "This is a new patient - take extra time to explain our processes",
    "previous_complaints": "Customer has previous complaints - be extra attentive and empathetic",
    "high_value": "High-value customer - ensure exceptional service and consider additional services",
}
OPENING_APPROACH = {
    "is_returning_patient": "Welcome them back and reference their previous visit if appropriate.",
    "is_new_patient": "Welcome them warmly and offer to explain our processes.",
    "previous_complaints": "Acknowledge any previous issues and assure them of your commitment to excellent service.",
}
OPENING_APPROACH_OTHER = "Use warm, professional greeting and focus on understanding their needs."
OPENING_APPROACH_UNKNOWN = "Use standard professional greeting and ask how you can help today."

# --- fixed values: insight rules of an analysed call ---------------------------

CALL_INSIGHTS = {
    "negative": ("Highly negative customer sentiment detected", "Consider immediate follow-up call"),
    "positive": "Positive customer interaction - potential for upselling",
    "phone": "Customer contact information captured",
    "medical": "Medical concerns mentioned: ",
    "insurance": "Insurance information discussed",
    "emergency": ("Emergency dental situation identified", "Prioritize scheduling urgently"),
    "appointment": "Scheduling opportunity identified",
    "complaint": ("Customer complaint detected", "Escalate to management"),
    "booking": ("Booking intent identified", "Provide available appointment slots"),
    "summary": {
        "high": "Call requires attention due to identified risk factors",
        "medium": "Positive interaction with business opportunities",
        "low": "Standard customer interaction",
    },
}

# --- fixed values: forecasting ---------------------------------------------------

FEATURE_WINDOWS = [7, 14, 30]
FORECAST = {"high_volume": 1.3, "low_volume": 0.7, "bad_sentiment": -0.1, "good_sentiment": 0.5,
            "revenue": 10000.0}
LEGACY_FORECAST = {"high_volume": 1.3, "low_volume": 0.7, "bad_sentiment": -0.2,
                   "revenue": 10000.0}

# --- fixed values: monitoring -----------------------------------------------------

THRESHOLDS = {"cpu_usage": (80.0, "high"), "memory_usage": (85.0, "high"),
              "disk_usage": (90.0, "critical")}
TREND_THRESHOLDS = {"cpu_usage": 80.0, "memory_usage": 85.0}
HEALTH_BANDS = {"cpu_usage": (70.0, 90.0, "High CPU usage"),
                "memory_usage": (80.0, 95.0, "High memory usage"),
                "disk_usage": (85.0, 95.0, "High disk usage")}
HEALTH_ADVICE = {
    "high cpu": "Consider scaling up compute resources or optimizing CPU-intensive processes",
    "high memory": "Monitor memory leaks and consider increasing available RAM",
    "high disk": "Clean up old files and consider expanding disk storage",
    "not responding": "Investigate and restart unresponsive agents",
    "critical alert": "Address critical alerts immediately to prevent system failure",
}
