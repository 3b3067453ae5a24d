"""Elements that are boundaries to hardware, codecs or live networks: known by name, with an honest error instead of a stand-in."""

from __future__ import annotations

# Launch names by kind.
NETWORK_SOURCES = "dashsrc hlssrc httpsrc livekitsrc localcudasrc dmabufsrc moqtsessionsrc moqtsrc onvifsrc remotesrc remotewssrc remotewtsrc rtmpsrc rtspserversrc rtspserversrcn rtspsrc srtsrc st2110ancsrc st2110audiosrc st2110jxssrc st2110videosrc udpsrc webrtcdatasrc webrtcsrc webrtcwhepsessionsrc websocketsrc".split()
CAPTURE_DEVICES = "aaudiosrc alsasrc avfvideosrc avfaudiosrc camera2src coreaudiosrc libcamerasrc mfvideosrc pipewiresrc pipewirevideosrc pulsesrc screencapturesrc v4l2src wasapisrc webcamerasrc".split()
NETWORK_SINKS = "livekitduplex livekitsink localcudasink dmabufsink moqtsink remotesink remotewssink rtmpsink rtspserversink srtsink st2110ancsink st2110audiosink st2110jxssink st2110videosink udpsink webrtcdatasink webrtcduplexsession webrtcsessionsink webrtcsink websocketsink wswiresink".split()
PRESENTATION = "aaudiosink alsasink canvassink coreaudiosink cudaglsink cudakmssink d3d11sink glimagesink kmssink metalvideosink pipewiresink pulsesink wasapisink waylandsink vulkanhdrpresentsink webgpucanvassink wgpupresentsink wgpusink".split()
CODECS = "dav1ddec rav1ddec ffmpegaudiodec ffmpegdec mediacodecdec nvdec opusdec jpegxsdec vaapidec vaapidech265 vorbisdec vtdec vtdech265 vulkanvideodec mjpegdec webpdec av1enc avenc_aac ffmpegenc x264enc mediacodecenc nvenc opusenc jpegxsenc vpxenc vtenc_h264 vtenc_h265 mjpegenc mfaacdecode mfdecode webcodecsdecode mfaacencode mfencode webcodecsencode mediacodecdech265 mediacodecench265".split()
MEMORY_BRIDGES = "cudaupload cudadownload cudatowgpu wgputocuda dmabuftowgpu wgputodmabuf".split()
PERIPHERALS = "pcmsink rtpsink sht3xsrc spidisplaysink uartsink uartsrc".split()
REMOTE_STEPS = "remotewstransform remotewttransform wswiretransform".split()
FOREIGN_HOSTS = "gstwrap v2element".split()
POOLS = "poolstage".split()
BOUNDARY: dict[str, str] = {
    name: kind
    for kind, names in (
        ("network source", NETWORK_SOURCES),
        ("capture device", CAPTURE_DEVICES),
        ("network sink", NETWORK_SINKS),
        ("presentation device", PRESENTATION),
        ("codec", CODECS),
        ("bridge between memories", MEMORY_BRIDGES),
        ("peripheral", PERIPHERALS),
        ("remote step", REMOTE_STEPS),
        ("host of foreign plugins", FOREIGN_HOSTS),
        ("pool of buffers, which Spark's memory manager is", POOLS),
    )
    for name in names
}
