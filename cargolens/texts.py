"""Explanation and advice by finding code."""

TEXTS = {
    "MLS-ALW-001": (
        "The callable is not on the list of known safe names for its framework.",
        "Check where the artifact comes from, or add the name to your own list.",
    ),
    "MLS-ALW-002": (
        "The module belongs to a trusted library but this name is not listed yet.",
        "Add the name to your own list if the source is known.",
    ),
    "MLS-PKL-001": (
        "Loading the artifact can call a function that runs code or opens connections.",
        "Do not load the artifact; ask for a format that holds data only.",
    ),
    "MLS-PKL-002": (
        "Look-alike characters in a callable name hide what is really called.",
        "Do not load the artifact.",
    ),
    "MLS-PKL-003": (
        "A persistent reference is resolved by code outside the artifact.",
        "Load it only with a loader whose resolver you control.",
    ),
    "MLS-PKL-004": (
        "The stream stops early and goes on in a later frame, which hides its tail.",
        "Do not load the artifact.",
    ),
    "MLS-PKL-005": (
        "Program source follows a broken stream.",
        "Do not load the artifact.",
    ),
    "MLS-PKL-006": (
        "The stream is far longer than a model needs; its tail was not analysed.",
        "Check the origin; treat the artifact as only partly analysed.",
    ),
    "MLS-BUNDLE-001": (
        "The configuration names a Python file that the loader imports.",
        "Review the file before allowing remote code.",
    ),
    "MLS-BUNDLE-002": (
        "The imported file uses calls that run code or reach outside the process.",
        "Review the listed lines.",
    ),
    "MLS-BUNDLE-003": (
        "The bundle holds a Python file that its configuration does not name.",
        "Check whether the file is needed.",
    ),
    "MLS-BUNDLE-004": (
        "The imported file builds names or code at run time.",
        "Review the listed lines.",
    ),
    "MLS-CMP-001": (
        "A small archive unpacks to a very large size.",
        "Unpack only with a strict size limit.",
    ),
    "MLS-CMP-002": (
        "The archive unpacks to far more than its own size.",
        "Unpack only with a strict size limit.",
    ),
    "MLS-CMP-003": (
        "The archive has unusually many members.",
        "Check the member list before unpacking.",
    ),
    "MLS-EXE-001": (
        "The artifact holds the header of an executable file.",
        "Do not use the artifact until the embedded file is explained.",
    ),
    "MLS-FMT-001": (
        "The content is not what the file extension promises.",
        "Do not load the artifact by its extension.",
    ),
    "MLS-FMT-002": (
        "The format can run code on load and the policy allows data formats only.",
        "Convert the artifact to a format that holds data only.",
    ),
    "MLS-GGUF-001": (
        "A metadata key suggests that its value is executed.",
        "Check the value of the key.",
    ),
    "MLS-GGUF-002": ("A metadata value holds a URL.", "Check who reads the value."),
    "MLS-GGUF-003": ("A metadata value holds an IP address.", "Check who reads the value."),
    "MLS-GGUF-004": ("A metadata value is unusually long.", "Check what the value holds."),
    "MLS-GGUF-005": (
        "The format version is unknown, so the analysis may be incomplete.",
        "Check the artifact with a newer release.",
    ),
    "MLS-GGUF-006": (
        "The file does not start with the bytes its format asks for.",
        "Do not load the artifact.",
    ),
    "MLS-JOBLIB-001": ("The lz4 codec is missing; content not analysed.", "Install the codec."),
    "MLS-JOBLIB-002": ("The zstd codec is missing; content not analysed.", "Install the codec."),
    "MLS-JOBLIB-003": (
        "Decompression hit the absolute size limit.",
        "Raise the limit only for a known source.",
    ),
    "MLS-BOMB-001": (
        "The compressed stream expands far beyond its own size.",
        "Do not decompress the artifact.",
    ),
    "MLS-KERAS-001": (
        "A Lambda layer runs serialized code when the model is loaded.",
        "Load in safe mode or ask for a model without Lambda layers.",
    ),
    "MLS-KERAS-002": (
        "The configuration needs custom objects from outside the framework.",
        "Review the custom objects before loading.",
    ),
    "MLS-KERAS-003": (
        "The HDF5 reader is missing, so the file was not analysed.",
        "Install the reader and scan again.",
    ),
    "MLS-NET-001": ("The URL belongs to a trusted domain.", "No action needed."),
    "MLS-NET-002": ("The URL belongs to an unknown domain.", "Check why it is there."),
    "MLS-NET-003": ("The URL points to a private address.", "Check why it is there."),
    "MLS-NET-004": ("The URL points to a public address.", "Check why it is there."),
    "MLS-NET-005": ("A public address stands in the text.", "Check why it is there."),
    "MLS-NET-006": (
        "The URL scheme reads local files or runs script.",
        "Remove the URL.",
    ),
    "MLS-NET-007": ("An inline image; it cannot run code.", "No action needed."),
    "MLS-NPY-001": (
        "An array of objects is stored through an object stream that can run code.",
        "Load with object arrays switched off.",
    ),
    "MLS-PARSE-001": (
        "The artifact could not be read and no other finding explains why.",
        "Check the artifact by hand.",
    ),
    "MLS-SEC-001": (
        "The text matches the pattern of a secret.",
        "Revoke the secret and remove it from the artifact.",
    ),
}

COMPLIANCE_DISCLAIMER = (
    "The mapping to requirements is automatic and helps an audit; it neither certifies that an "
    "artifact complies with a standard nor replaces an assessment by an accredited body."
)

PATTERN_TEXT = (
    "The artifact matches a known vulnerability pattern.",
    "See the references of the finding.",
)
