"""Fixed values that results depend on."""

# Token ids, label marker and defaults of the data format.
MASK_ID = 126336
END_OF_TEXT_ID = 126081
EOS_IDS = (126081, 126348)
IGNORE_LABEL = -100
MAX_LENGTH = 8192
BATCH_SIZE = 2
NOISE_LOW = 0.1
NOISE_HIGH = 0.9
SEED = 42
VOCAB_SIZE = 120000
UNKNOWN_ID = 0
PAD_ID = 0
STOP_TEXT = "<|eot_id|>"
END_OF_TEXT = "<|endoftext|>"
