"""Table schemas and default values."""

from __future__ import annotations

CALL = ("call_id string, transcript string, ts timestamp, duration double, "
        "caller map<string,string>, file_type string, source_id string, source_file string, "
        "acquired_at timestamp, audio_file string, needs_transcription boolean")
CHUNK = "call_id string, seq int, ts timestamp, speaker string, text string, staff_id string"
INSIGHT = ("call_id string, ts timestamp, clinic_mentioned string, primary_intent string, "
           "secondary_intents array<string>, sentiment_score double, "
           "emotional_journey map<string,double>, urgency_level int, resolution_status string, "
           "staff_performance map<string,double>, revenue_opportunity double, "
           "service_requests array<string>, pain_points array<string>, "
           "success_factors array<string>, next_actions array<string>, confidence_score double")
# a stored model answer: the insight without its id and time
ANSWER = INSIGHT.split(", ", 2)[2]
ALERT = ("alert_id string, ts timestamp, severity string, component string, message string, "
         "acknowledged boolean, resolved boolean")
METRIC = "ts timestamp, component string, name string, value double"
PREDICTION = ("prediction_type string, prediction_date date, predicted_value double, "
              "confidence_score double, actual_value double, model_version string")
SOURCE = ("source_id string, source_type string, name string, config map<string,string>, "
          "enabled boolean, polling_interval int")

LIST_FIELDS = ["secondary_intents", "service_requests", "pain_points", "success_factors",
               "next_actions"]
EXPORT_FIELDS = ["call_id", "ts", "clinic_mentioned", "primary_intent", "secondary_intents",
                 "sentiment_score", "urgency_level", "resolution_status", "revenue_opportunity",
                 "service_requests", "pain_points", "success_factors", "next_actions",
                 "confidence_score"]
