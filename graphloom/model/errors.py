"""Error codes. Fatal errors end a run; all others fail the step that raised them."""

from __future__ import annotations


class GraphError(Exception):
    """An error with a stable code."""

    code = "UNEXPECTED_ERROR"
    fatal = False

    def __init__(self, message: str = "", **details):
        super().__init__(message or self.code)
        self.details = details


def _error(name: str, code: str, fatal: bool = False) -> type[GraphError]:
    return type(name, (GraphError,), {"code": code, "fatal": fatal})


DuplicateKeyError = _error("DuplicateKeyError", "DUPLICATE_KEY_DETECTED")
MissingKeyError = _error("MissingKeyError", "MISSING_KEY_ERROR")
UploadError = _error("UploadError", "UPLOAD_ERROR")
UnknownStepError = _error("UnknownStepError", "UNKNOWN_STEP_ID_SPECIFIED_IN_START_STATE")
UnaccountedStepError = _error("UnaccountedStepError", "UNACCOUNTED_STEP_START_STATES")
ConfigError = _error("ConfigError", "CONFIG_VALIDATION_ERROR", fatal=True)
ConfigFieldMissingError = _error("ConfigFieldMissingError", "LOCAL_CONFIG_FIELD_MISSING", fatal=True)
ConfigFieldTypeError = _error("ConfigFieldTypeError", "LOCAL_CONFIG_FIELD_TYPE_MISMATCH", fatal=True)
ProviderError = _error("ProviderError", "PROVIDER_API_ERROR")
ProviderAuthenticationError = _error("ProviderAuthenticationError", "PROVIDER_AUTHENTICATION_ERROR", fatal=True)
ProviderAuthorizationError = _error("ProviderAuthorizationError", "PROVIDER_AUTHORIZATION_ERROR")
RetriesExceededError = _error("RetriesExceededError", "PROVIDER_RETRIES_EXCEEDED")
DuplicateRawDataError = _error("DuplicateRawDataError", "DUPLICATE_RAW_DATA_NAME")
NoSchemaError = _error("NoSchemaError", "NO_SCHEMA_FOR_CLASS")
SchemaReferenceError = _error("SchemaReferenceError", "CANNOT_RESOLVE_SCHEMA_REF")
InvalidRelationshipClassError = _error("InvalidRelationshipClassError", "INVALID_RELATIONSHIP_CLASS")
MissingTargetKeyError = _error("MissingTargetKeyError", "MISSING_RELATIONSHIP_TO_KEY")
MissingTargetTypeError = _error("MissingTargetTypeError", "MISSING_RELATIONSHIP_TO_TYPE")
InvalidFileError = _error("InvalidFileError", "INVALID_FILE_DATA")
UploadFailedError = _error("UploadFailedError", "INTEGRATION_UPLOAD_FAILED")
UploadAfterJobEndedError = _error("UploadAfterJobEndedError", "INTEGRATION_UPLOAD_AFTER_JOB_ENDED", fatal=True)
SyncResponseError = _error("SyncResponseError", "SYNCHRONIZATION_API_RESPONSE_ERROR")
SyncUnexpectedError = _error("SyncUnexpectedError", "UNEXPECTED_SYNCRONIZATION_ERROR")


def describe(error: BaseException, message: str, event: str = "step_failure") -> dict[str, str]:
    """Event text of an error: name, and a description with code and reason."""
    return {"name": event, "description": f"{message} (errorCode={getattr(error, 'code', GraphError.code)}, reason={error})"}
